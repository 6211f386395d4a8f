"""Evaluation and comparison against recorded results and hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from skein.functions.columns import ratio
from skein.operators import auc as roc
from skein.operators import compare, detect, evaluate, prep, profile
from skein.schema import CLASSES, NORMAL

# Recorded confusion matrices, class sizes and detection totals.
FOREST_MATRIX = [
    [4531, 2, 0, 0, 689],
    [0, 3939, 0, 2, 4],
    [1, 0, 5187, 0, 47],
    [0, 0, 0, 4814, 2],
    [151, 6, 36, 1, 5023],
]
ENHANCED_MATRIX = [
    [5039, 2, 0, 0, 181],
    [0, 3907, 0, 0, 38],
    [1, 0, 5069, 0, 165],
    [1, 74, 4, 4684, 53],
    [1630, 4, 19, 0, 3564],
]
CLASS_SIZES = {
    "Blackhole Attack": 26110,
    "Flooding Attack": 19726,
    "Normal Traffic": 26172,
    "Sybil Attack": 24077,
    "Wormhole Attack": 26086,
}
TEST_SIZES = {
    "Blackhole Attack": 5222,
    "Flooding Attack": 3945,
    "Normal Traffic": 5235,
    "Sybil Attack": 4816,
    "Wormhole Attack": 5217,
}
DETECTED = {
    "Sybil Attack": 170,
    "Blackhole Attack": 5677,
    "Wormhole Attack": 9511,
    "Flooding Attack": 3650,
    "Normal Traffic": 482,
}


def long_matrix(spark, matrix):
    rows = [
        (CLASSES[i], CLASSES[j], n) for i, line in enumerate(matrix) for j, n in enumerate(line) if n
    ]
    return spark.createDataFrame(rows, "actual string, predicted string, n long")


def test_forest_matrix(spark):
    row = evaluate.weighted_metrics(long_matrix(spark, FOREST_MATRIX)).first()
    assert round(row["accuracy"], 4) == 0.9615
    assert round(row["precision"], 4) == 0.9637
    assert round(row["f1_score"], 4) == 0.9615
    wide = evaluate.confusion_matrix(long_matrix(spark, FOREST_MATRIX), CLASSES).orderBy("actual")
    assert [list(r)[1:] for r in wide.collect()] == FOREST_MATRIX


def test_enhanced_report(spark):
    report = evaluate.classification_report(long_matrix(spark, ENHANCED_MATRIX))
    rows = {r["label"]: r for r in report.collect()}
    assert len(rows) == 8
    assert rows["accuracy"]["support"] == pytest.approx(0.9111111)
    assert rows["macro avg"]["f1_score"] == pytest.approx(0.9147172367)
    assert rows["weighted avg"]["f1_score"] == pytest.approx(0.9099161561)
    assert rows["Blackhole Attack"]["precision"] == pytest.approx(0.7553590166)


def test_split_allocation(spark):
    counts = spark.createDataFrame(list(CLASS_SIZES.items()), "label string, n long")
    got = {r["label"]: r["n_test"] for r in prep.split_allocation(counts, "label").collect()}
    assert got == TEST_SIZES


def test_detection_totals(spark):
    rows = [(c, n, DETECTED[c]) for c, n in CLASS_SIZES.items()]
    flows = (
        spark.createDataFrame(rows, "label string, n long, hit long")
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .withColumn("flag", F.col("i") <= F.col("hit"))
    )
    row = evaluate.binary_confusion(flows, F.col("label") != NORMAL, F.col("flag")).first()
    assert row["precision"] == pytest.approx(0.975269, abs=1e-6)
    assert row["recall"] == pytest.approx(0.198002, abs=1e-6)
    assert row["f1_score"] == pytest.approx(0.329174, abs=1e-6)
    assert row["accuracy"] == pytest.approx(0.365864, abs=1e-6)


def test_model_delta_of_recorded_metrics(spark):
    base = spark.createDataFrame(
        [
            ("Logistic Regression", 0.7583, 0.76, 0.9454),
            ("Random Forest", 0.9615, 0.9615, 0.9971),
            ("SVM", 0.621, 0.6101, 0.8971),
        ],
        "Model string, Test_Accuracy double, Test_F1 double, Test_AUC double",
    )
    enhanced = spark.createDataFrame(
        [
            ("Logistic Regression (TDA)", 0.8252506650296706, 0.8177235720944136, 0.9718120668258097),
            ("Random Forest (TDA)", 0.9111111111111111, 0.9099161560794548, 0.9890192929847207),
            ("SVM (TDA)", 0.7732351135666052, 0.7785269606138164, 0.9543462347050181),
        ],
        ["Model", "Test Accuracy", "Test F1 (weighted)", "Test AUC"],
    )
    left = compare.unify_metrics(base, "Baseline")
    right = compare.unify_metrics(enhanced, "Enhanced", "TDA")
    delta = compare.model_delta(left, right)
    got = {r["model"]: r for r in delta.collect()}
    assert got["Logistic Regression"]["accuracy_delta_pct"] == pytest.approx(8.829047214779193)
    assert got["Random Forest"]["f1_delta_pct"] == pytest.approx(-5.364934365111313)
    assert got["SVM"]["auc_delta_pct"] == pytest.approx(6.381254565267863)
    table = {r["model"]: r for r in compare.percent_table(delta).collect()}
    assert table["SVM"]["improvement_pct"] == 24.51
    test = compare.t_test(delta, "accuracy_delta_pct")
    values = [8.829047214779193, -5.240654070607262, 24.51451104132129]
    mean = sum(values) / 3
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / 2)
    assert test["t"] == pytest.approx(mean / (spread / math.sqrt(3)))
    assert not test["significant"]
    assert compare.best_model(right).first()["model"] == "Random Forest"
    pivot = compare.metrics_pivot(compare.metrics_union(left, right), ["Baseline", "Enhanced"])
    assert {r["model"]: r["Baseline"] for r in pivot.collect()}["SVM"] == 0.621


@pytest.mark.parametrize(
    ("t", "df", "p"), [(0.0, 2, 1.0), (4.302652729911275, 2, 0.05), (2.2281388519649385, 10, 0.05), (1.0, 1, 0.5)]
)
def test_t_distribution(t, df, p):
    assert compare.t_two_sided(t, df) == pytest.approx(p, abs=1e-9)


def auc_of(spark, pairs):
    df = spark.createDataFrame(pairs, "score double, pos int")
    return roc.auc(df, {"s": F.col("score")}, {"t": F.col("pos")}).first()["auc"]


def test_auc_cases(spark):
    assert auc_of(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)]) == pytest.approx(0.75)
    assert auc_of(spark, [(1.0, 0), (1.0, 1), (1.0, 1)]) == 0.5
    assert auc_of(spark, [(0.5, 0), (0.5, 1), (0.9, 1)]) == pytest.approx(0.75)
    assert auc_of(spark, [(0.1, 1), (0.2, 1)]) is None


def test_roc_ends(spark):
    df = spark.createDataFrame([(float(i % 7), i % 2) for i in range(50)], "score double, pos int")
    points = roc.roc_points(df, F.col("score"), {"t": F.col("pos")}).orderBy(F.desc("threshold")).collect()
    assert len(points) == 8
    assert (points[0]["fpr"], points[0]["tpr"]) == (0.0, 0.0)
    assert (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)


def test_threshold_is_strict_and_zero_spread_is_null(spark):
    rows = [(1, NORMAL, 0.0, 1.0, 1.0), (2, NORMAL, 2.0, 1.0, 3.0), (3, "Sybil Attack", 1.0 + 3 * math.sqrt(2.0), 1.0, 20.0)]
    df = spark.createDataFrame(
        rows, "flow_id long, label string, c2_distance double, network_distance double, physical_distance double"
    )
    stats = detect.normal_stats(df)
    got = {r["flow_id"]: r for r in detect.zscore_detect(df, stats).collect()}
    assert got[3]["c2_zscore"] == pytest.approx(3.0)
    assert got[3]["network_zscore"] is None and got[3]["network_anomaly"] is False
    assert got[1]["pattern"] == "000" and got[1]["anomaly_detected"] is False
    moved = df.withColumn("network_distance", F.when(F.col("flow_id") == 3, F.lit(2.0)).when(F.col("flow_id") == 1, F.lit(0.5)))
    seen = {r["flow_id"]: r for r in detect.zscore_detect(moved, stats).collect()}
    assert seen[3]["network_zscore"] == math.inf and seen[3]["network_anomaly"]
    assert seen[1]["network_zscore"] == -math.inf and seen[2]["network_zscore"] is None
    assert not any(r[c] is None for r in seen.values() for c in ("anomaly_detected", "pattern", "network_anomaly"))
    assert got[3]["physical_anomaly"] and got[3]["anomaly_detected"]


def test_histogram_of_a_single_value(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    rows = evaluate.histogram(df, ["x"], F.lit("all"), bins=4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [0, 0, 5, 0]
    assert rows[0]["left_edge"] == 1.5 and rows[2]["density"] == pytest.approx(4.0)


def test_reports_on_hand_made_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, None), (2, "a", 1.0, 2.0), (3, "b", float("nan"), 2.0), (4, "b", float("inf"), 0.0)],
        "flow_id long, label string, x double, y double",
    )
    health = profile.feature_health(df, ["x", "y"]).first()
    assert (health["nan_cells"], health["inf_cells"], health["zero_columns"]) == (2, 1, 0)
    scan = profile.scan_profile(df.select("label", "x").withColumn("flow_id", F.lit(1))).first()
    assert scan["duplicate_rows"] == 1 and scan["n_nulls"] == 0
    assert df.select(ratio(F.lit(1), F.lit(0)).alias("r")).first()["r"] == 0.0


def test_scaling_conventions(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(10)], "x double, same double")
    fitted = {r["feature"]: r for r in prep.fit_scaler(df, ["x", "same"]).collect()}
    assert fitted["x"]["std"] == pytest.approx(2.8722813)
    scaled = prep.apply_scaler(df, prep.fit_scaler(df, ["x", "same"])).collect()
    assert all(r["same"] == 0.0 for r in scaled)
    assert sum(r["x"] for r in scaled) == pytest.approx(0.0)


def test_unknown_port_is_null(spark):
    df = spark.createDataFrame(
        [(1, "10.0.0.9", 9, "10.0.0.77", 1234, "UDP", 1.5)],
        "flow_id long, src_addr string, src_port int, dst_addr string, dst_port int, protocol string, flow_duration_s double",
    )
    row = prep.encode_c2(df).first()
    assert (row["src_addr_octet"], row["src_port_binary"], row["dst_addr_octet"], row["dst_port_binary"]) == (9, 0, 77, None)


def test_thresholds_that_differ_by_summation_noise_are_one(spark):
    rows = spark.createDataFrame([(0.3, 1), (0.1 + 0.2, 0), (1.0, 1), (0.0, 0)], "score double, t int")
    found = {r["threshold"]: (r["fpr"], r["tpr"]) for r in roc.roc_points(rows, F.col("score"), {"t": F.col("t")}).collect()}
    assert found == {float("inf"): (0.0, 0.0), 1.0: (0.0, 0.5), 0.3: (0.5, 1.0), 0.0: (1.0, 1.0)}


def test_level_importances_at_the_cut_go_by_name(spark):
    rows = spark.createDataFrame([("a", 0.1 + 0.2), ("C2_H0_b", 0.3), ("z", 0.1)], "feature string, importance double")
    assert [r["feature"] for r in compare.top_features(rows, 1).collect()] == ["C2_H0_b"]
    groups = compare.importance_groups(rows, 1).where("facet = 'type'").collect()
    assert {r["name"]: r["n_top"] for r in groups} == {"original": 0, "topology": 1}


def test_importances_without_digits_rank_as_they_are(spark):
    rows = spark.createDataFrame([("a", 0.1 + 0.2), ("C2_H0_b", 0.3), ("z", 0.1 + 0.2)], "feature string, importance double")
    assert [r["feature"] for r in compare.top_features(rows, 2, digits=None).collect()] == ["a", "z"]
