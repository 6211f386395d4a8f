"""Model operators on the derived flow table, kept small by few trees and iterations."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from contract import fixtures as fx
from contract import queries
from skein.operators import auc as roc
from skein.operators import models, prep
from skein.plans.supervised import compare_models
from skein.schema import CLASSES, NORMAL, RAW_FEATURES
from skein.session import settle


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    """Raw features with a learnable class: the label follows two of the columns."""
    raw = prep.original_features(fx.flows(spark, sf_dir))
    level = (F.col("mean_packet_size") > 110).cast("int") + (F.col("lost_packets") > 10).cast("int")
    names = F.array(*[F.lit(c) for c in (NORMAL, "Blackhole Attack", "Sybil Attack")])
    named = raw.withColumn("label", F.element_at(names, level + 1))
    split = prep.stratified_split(named.select("flow_id", "label"))
    joined = named.join(split.select("flow_id", "split"), "flow_id")
    return settle(models.scale_on_train(joined, RAW_FEATURES))


CLASS_NAMES = ["Blackhole Attack", NORMAL, "Sybil Attack"]


def test_models_learn_and_compare(table, spark):
    fits = {
        "Logistic Regression": lambda t: models.fit_logistic(t, RAW_FEATURES, max_iter=50),
        "Random Forest": lambda t: models.fit_forest(t, RAW_FEATURES, n_trees=10, max_depth=6),
        "SVM": lambda t: models.fit_svm(t, RAW_FEATURES, max_iter=20),
    }
    metrics, fitted = compare_models(table, fits, CLASS_NAMES)
    got = {r["model"]: r for r in metrics.collect()}
    assert set(got) == set(fits)
    assert got["Random Forest"]["accuracy"] > 0.95
    assert got["Logistic Regression"]["accuracy"] > 0.85
    assert got["SVM"]["accuracy"] > 0.75
    assert all(0.8 < r["auc"] <= 1.0 for r in got.values())

    importance = models.feature_importance(fitted["Random Forest"], RAW_FEATURES, spark)
    rows = importance.orderBy(F.desc("importance")).collect()
    assert len(rows) == 22 and abs(sum(r["importance"] for r in rows) - 1.0) < 1e-9

    catalogue = {r["model"]: r for r in models.model_catalogue(fitted, RAW_FEATURES, spark).collect()}
    assert catalogue["Random Forest"]["params"]["numTrees"] == "10"
    assert not catalogue["Random Forest"]["untuned"] and catalogue["SVM"]["n_classes"] == 3


def test_svm_persistence(table, tmp_path):
    model = models.fit_svm(table, RAW_FEATURES, max_iter=5)
    model.save(str(tmp_path / "svm"))
    again = models.KernelSvm.load(str(tmp_path / "svm"))
    one = models.score_rows(model, table, ["flow_id"]).orderBy("flow_id").collect()
    two = models.score_rows(again, table, ["flow_id"]).orderBy("flow_id").collect()
    assert one == two
    assert models.model_classes(model) == CLASS_NAMES and model.pairs == [(0, 1), (0, 2), (1, 2)]
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and min(r["probabilities"]) >= 0 for r in one)
    assert all(r["predicted"] == CLASS_NAMES[max(range(3), key=r["probabilities"].__getitem__)] for r in one)


def test_coupling_gives_back_consistent_probabilities():
    r = np.random.default_rng(1)
    p = r.dirichlet([1.0] * 4, 50)
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    pairwise = np.stack([p[:, a] / (p[:, a] + p[:, b]) for a, b in pairs], axis=1)
    assert np.allclose(models.couple(pairwise, pairs, 4), p, atol=1e-6)
    # noise: least squares against a dense search over a grid of three classes
    three = [(0, 1), (0, 2), (1, 2)]
    noisy = np.array([[0.9, 0.3, 0.4]])
    grid = np.array([(a, b, 1 - a - b) for a in np.linspace(0, 1, 201) for b in np.linspace(0, 1 - a, 201)])
    cost = sum((r_ab * grid[:, b] - (1 - r_ab) * grid[:, a]) ** 2 for r_ab, (a, b) in zip(noisy[0], three))
    assert np.allclose(models.couple(noisy, three, 3)[0], grid[cost.argmin()], atol=0.02)


def test_pairs_are_fitted_in_common_passes(spark, table, monkeypatch):
    passes = []
    real = models._pair_sums
    monkeypatch.setattr(models, "_pair_sums", lambda *a: passes.append(len(a[2])) or real(*a))
    model = models.fit_svm(table, RAW_FEATURES[:4], max_iter=3, terms=16)
    assert set(passes) == {3} and model.slopes.shape == (17, 3)
    one_class = models.fit_svm(table.where(F.col("label") == NORMAL), RAW_FEATURES[:2], max_iter=2, terms=8)
    assert {tuple(r["probabilities"]) for r in models.score_rows(one_class, table.where(F.col("label") == NORMAL), ["flow_id"]).collect()} == {(1.0,)}


def test_svm_passes_read_packed_rows_and_margins(spark, monkeypatch):
    r = np.random.default_rng(3)
    x, label, weight = r.normal(size=(500, 4)), r.integers(0, 4, 500), r.uniform(0.5, 2.0, 500)
    pairs, basis = models._class_pairs(4), models._fourier_basis(4, 0.3, 8, 1)
    rows = spark.createDataFrame([(float(w), float(c), v.tolist()) for w, c, v in zip(weight, label, x)], "weight double, label_index double, x array<double>")
    packs = settle(models._pack_rows(rows))
    assert packs.columns == ["pack"] and packs.count() < 50
    z = models._fourier(x, basis)
    sign = np.array([[(c == a) * 1.0 - (c == b) for a, b in pairs] for c in label])
    got = models._pair_sums(packs, basis, pairs, lambda z, sign, weight: (z.T @ (sign * weight[:, None])).ravel())
    assert np.allclose(got, (z.T @ (sign * weight[:, None])).ravel())
    slopes, curves = r.normal(size=(9, 6)), r.normal(size=(6, 2))
    own, leads = models._own_pairs(pairs, 4)
    margins = settle(models._pack_margins(packs, basis, slopes, own))
    m = z @ slopes
    p = 1 / (1 + np.exp(-(m * curves[:, 0] + curves[:, 1])))
    off = np.where(sign != 0, p - (sign > 0), 0.0)
    loss = -np.where(sign > 0, np.log(p), np.where(sign < 0, np.log(1 - p), 0.0)).sum()
    assert np.allclose(models._curve_sums(margins, curves, own, leads), [*(off * m).sum(axis=0), *off.sum(axis=0), loss])
    # all passes of a fit: packed rows for the machines, packed margins for the curves
    seen = []
    real = models._task_sums
    monkeypatch.setattr(models, "_task_sums", lambda *a: seen.append(a[0].columns) or real(*a))
    named = rows.select(*[F.get("x", F.lit(j)).alias(f"x{j}") for j in range(4)], F.col("label_index").cast("string").alias("label"))
    models.fit_svm(named, ["x0", "x1", "x2", "x3"], max_iter=2, terms=8)
    assert seen and all(columns == ["pack"] for columns in seen)


def test_scores_from_coefficients_and_optimum(table, spark):
    train = table.where("split = 'train'")
    model = models.fit_logistic(train, RAW_FEATURES, max_iter=300)
    got = models.score_columns(table, models.coefficient_table(model, RAW_FEATURES, spark), ["flow_id"]).orderBy("flow_id").collect()
    want = models.score_rows(model, table, ["flow_id"]).orderBy("flow_id").collect()
    assert [r["predicted"] for r in got] == [r["predicted"] for r in want]
    assert np.allclose([r["probabilities"] for r in got], [r["probabilities"] for r in want], atol=1e-9)
    flat = models.penalty_gradient(train, model, RAW_FEATURES).collect()
    assert len(flat) == 3 * 23 and max(abs(r["gradient"]) for r in flat) < 1e-3
    early = models.fit_logistic(train, RAW_FEATURES, max_iter=2)
    assert max(abs(r["gradient"]) for r in models.penalty_gradient(train, early, RAW_FEATURES).collect()) > 1e-3


def test_train_table_fits_its_scaler_on_settled_rows(spark, sf_dir, monkeypatch):
    plans = []
    real = models.fit_scaler
    monkeypatch.setattr(models, "fit_scaler", lambda df, c: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, c))
    got = queries._train_table(spark, sf_dir)
    assert len(plans) == 1 and "Join" not in plans[0] and "FileScan" not in plans[0]
    train = got.where("split = 'train'").agg(F.avg("tx_packets").alias("m"), F.stddev_pop("tx_packets").alias("s")).first()
    assert got.count() == 1000 and abs(train["m"]) < 1e-9 and abs(train["s"] - 1) < 1e-9


def test_gradient_is_one_array_a_task_and_skips_missing_features(table, spark, monkeypatch):
    names = RAW_FEATURES[:5]
    train = table.where("split = 'train'")
    model = models.fit_logistic(train, names, max_iter=3)
    holed = train.withColumn(names[0], F.when(F.col("flow_id") % 7 != 0, F.col(names[0])))
    passes = []
    real = models._task_sums
    monkeypatch.setattr(models, "_task_sums", lambda *a: passes.append(a[0].columns) or real(*a))
    got = {(r["class"], r["feature"]): r["gradient"] for r in models.penalty_gradient(holed, model, names).collect()}
    assert passes == [["place", "weight", "x"]]
    weights = {r["label"]: r["weight"] for r in prep.class_weights(train).collect()}
    rows = holed.select("label", *names).collect()
    whole = [r for r in rows if r[names[0]] is not None]
    x = np.array([[1.0, *[float(r[f]) for f in names]] for r in whole])
    b = {(r["class"], r["feature"]): r["coefficient"] for r in models.coefficient_table(model, names, spark).collect()}
    slopes = np.array([[b[c, f] for f in (None, *names)] for c in CLASS_NAMES])
    p = np.exp(x @ slopes.T)
    p /= p.sum(axis=1, keepdims=True)
    off = (p - np.array([[r["label"] == c for c in CLASS_NAMES] for r in whole])) * np.array([[weights[r["label"]]] for r in whole])
    want = off.T @ x / sum(weights[r["label"]] for r in rows)
    want[:, 1:] += slopes[:, 1:] / len(rows)
    assert 0 < len(whole) < len(rows)
    assert np.allclose([[got[c, f] for f in (None, *names)] for c in CLASS_NAMES], want, atol=1e-12)


def test_class_order_and_persistence(table, tmp_path):
    model = models.fit_logistic(table, RAW_FEATURES, max_iter=10)
    models.check_class_order(model, CLASS_NAMES)
    with pytest.raises(ValueError):
        models.check_class_order(model, CLASSES)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    keep = ["flow_id", "label"]
    one = models.score_rows(model, table, keep).orderBy("flow_id").collect()
    two = models.score_rows(again, table, keep).orderBy("flow_id").collect()
    assert one == two


def test_cross_validation(table):
    folded = prep.stratified_folds(table.where("split = 'train'").drop("split"), n_folds=3)
    scores = settle(
        models.cross_validate(folded, lambda t: models.fit_forest(t, RAW_FEATURES, n_trees=5, max_depth=5))
    )
    assert scores.count() == 3
    row = models.cv_summary(scores).first()
    assert row["cv_mean"] > 0.9 and 0 <= row["cv_std"] < 0.1


def test_isolation_forest_finds_outliers(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("flow_id"),
        *[
            (F.rand(seed=i) + F.when(F.col("id") % 100 == 0, 4.0 + i).otherwise(0.0)).alias(f"x{i}")
            for i in range(3)
        ],
        F.when(F.col("id") % 100 == 0, "out").otherwise("in").alias("label"),
    )
    names = ["x0", "x1", "x2"]
    forest = settle(models.fit_isolation_forest(rows, names, n_trees=30, sample=128))
    assert forest.count() == 30
    scored = settle(models.score_isolation_forest(rows, forest, names))
    target = {"out": (F.col("label") == "out").cast("int")}
    assert roc.auc(scored, {"s": F.col("score")}, target).first()["auc"] > 0.99
    flagged = models.isolation_flags(scored, 0.2).where("anomaly").count()
    assert abs(flagged - 400) <= 5


def test_forest_samples_come_from_all_rows(spark):
    rows = spark.range(0, 20_000, 1, 7).select(F.col("id").alias("flow_id"), F.col("id").cast("double").alias("x0"))
    drawn = settle(models.draw_samples(rows, ["x0"], "flow_id", n_trees=200, sample=64))
    per_tree = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("flow_id").alias("d")).collect()
    assert len(per_tree) == 200 and all((r["n"], r["d"]) == (64, 64) for r in per_tree)
    # 12,800 draws over 20 stretches of the table: 640 each, within five deviations
    spread = drawn.groupBy((F.col("flow_id") / 1000).cast("int")).count().collect()
    assert len(spread) == 20 and all(abs(r["count"] - 640) < 5 * 640**0.5 for r in spread)
    # far more rows than one tree's sample, or a small pool of them, take part
    assert drawn.select("flow_id").distinct().count() > 9000
    assert all(r["x"] == [float(r["flow_id"])] for r in drawn.limit(50).collect())
    plan = models.fit_isolation_forest(rows, ["x0"], n_trees=5, sample=16)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_forest_on_small_and_empty_tables(spark):
    rows = spark.range(9).select(F.col("id").alias("flow_id"), (F.col("id") % 2).cast("double").alias("x0"))
    assert models.draw_samples(rows, ["x0"], "flow_id", n_trees=3, sample=64).count() == 27
    forest = settle(models.fit_isolation_forest(rows, ["x0"], n_trees=3, sample=64))
    assert {r["size"][0] for r in forest.collect()} == {9}
    assert models.fit_isolation_forest(rows.limit(0), ["x0"], n_trees=3).count() == 0
