"""Neighbourhood operators against plain windows and brute force, also on skewed data."""

import itertools

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contract import fixtures as fx
from contract import queries
from skein.functions.barcode import barcodes
from skein.operators import distance, features, knn, neighbors, prep, topology
from skein.operators.ranks import dense_position, exact_quantiles, hash_rank
from skein.plans.supervised import local_bars
from skein.session import settle


def brute_knn(ids, vectors, k):
    # axis by axis, as the join adds up: ties are ties of these sums
    dist = np.sqrt(sum((vectors[:, None, j] - vectors[None, :, j]) ** 2 for j in range(vectors.shape[1])))
    out = {}
    for i, own in enumerate(ids):
        order = np.lexsort((ids, ids != own, dist[i]))[:k]
        out[own] = list(ids[order])
    return out


def check_knn(points, k, **small):
    got = settle(knn.knn_join(points, k)).toPandas()
    rows = points.toPandas()
    for (s, m), part in rows.groupby(["split", "manifold"]):
        vectors = np.stack(part["vec"].to_numpy())
        want = brute_knn(part["flow_id"].to_numpy(), vectors, k)
        mine = got[(got["split"] == s) & (got["manifold"] == m)].sort_values(["flow_id", "rank"])
        assert mine.groupby("flow_id")["neighbor_id"].apply(list).to_dict() == want
    return got


@pytest.fixture
def tiny_packs(monkeypatch):
    """Force many cells, packs and lanes on small data."""
    monkeypatch.setattr(knn, "PACK", 16)
    monkeypatch.setattr(knn, "MEETINGS_PER_LANE", 3)


def test_knn_many_cells(spark, sf_dir, tiny_packs):
    points = prep.scale_vectors(prep.long_points(fx.wide_points(spark, sf_dir)))
    got = check_knn(points.select("flow_id", "manifold", "split", "vec"), 7)
    selves = got[got["rank"] == 0]
    assert (selves["flow_id"] == selves["neighbor_id"]).all()


def test_knn_with_a_third_of_copies_and_ties(spark, tiny_packs):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        if i % 3 == 0:
            vec = [0.5, 0.5]
        elif i % 3 == 1:
            vec = [float(x) for x in rng.integers(0, 4, 2)]
        else:
            vec = [float(x) for x in rng.normal(size=2)]
        rows.append(Row(flow_id=i * 7, split="train", manifold="C2", vec=vec))
    check_knn(spark.createDataFrame(rows), 6)


def test_teams_of_packs_get_a_data_pack_once(spark, tiny_packs, monkeypatch):
    rng = np.random.default_rng(4)
    vecs = [rng.normal(size=3) if i % 4 else rng.integers(0, 3, 3) for i in range(900)]
    rows = [Row(flow_id=i * 3, split="ab"[i % 5 == 0], manifold="C2", vec=[float(x) for x in v]) for i, v in enumerate(vecs)]
    points = settle(spark.createDataFrame(rows))
    monkeypatch.setattr(knn._Join, "team_rows", lambda self, dims: 150)
    monkeypatch.setattr(knn, "MET_TOGETHER", 5)
    check_knn(points, 6)
    met = knn._Join(points, 6, ["split", "manifold"], "flow_id", "vec", 1).meetings()
    asks = met.where("near < 0").groupBy("team").agg(F.count(F.lit(1)).alias("packs"), F.sum(F.size("q_ids")).alias("rows")).collect()
    assert max(r["packs"] for r in asks) > 3 and max(r["rows"] for r in asks) <= 150
    assert met.where("near >= 0").groupBy("team", "d_pack").count().where("count > 1").isEmpty()


def test_knn_without_vectors_is_the_same_join(spark, sf_dir, tiny_packs):
    points = settle(prep.scale_vectors(prep.long_points(fx.wide_points(spark, sf_dir))).select("flow_id", "manifold", "split", "vec"))
    plain, found = knn.knn_join(points, 4, vectors=False), knn.knn_join(points, 4)
    assert plain.columns == [c for c in found.columns if c != "neighbor_vec"]
    assert plain.exceptAll(found.select(*plain.columns)).isEmpty() and plain.count() == 6000


def test_local_bars_do_not_shuffle_neighbours(spark, sf_dir):
    flows = fx.flows(spark, sf_dir).limit(300)
    split = settle(prep.stratified_split(flows.select("flow_id", "label")))
    assert "collect_list" not in local_bars(flows, split, 6)._jdf.queryExecution().executedPlan().toString()


def test_knn_fewer_points_than_k(spark):
    rows = [Row(flow_id=i, split="test", manifold="C2", vec=[float(i)]) for i in range(4)]
    found = knn.knn_join(spark.createDataFrame(rows), 10).collect()
    assert len(found) == 16


def test_knn_on_flow_columns_of_5_15_and_2(spark, sf_dir, tiny_packs):
    points = prep.scale_vectors(prep.long_points(prep.manifold_vectors(fx.flows(spark, sf_dir).limit(700), ["flow_id"])))
    points = settle(points.select("flow_id", "manifold", F.lit("all").alias("split"), "vec"))
    assert {r[0] for r in points.select(F.size("vec")).distinct().collect()} == {2, 5, 15}
    check_knn(points, 9)
    counts = {r["manifold"]: r for r in knn.candidates_per_row(points, 9).collect()}
    assert set(counts) == {"C2", "Network", "Physical"} and all(r["rows"] == 700 for r in counts.values())
    assert counts["Physical"]["per_row"] < 250 and all(r["per_row"] <= 700 for r in counts.values())


def test_clouds_are_the_neighbourhoods_of_the_join(spark, sf_dir, tiny_packs):
    points = settle(prep.scale_vectors(prep.long_points(fx.wide_points(spark, sf_dir))).select("flow_id", "manifold", "split", "vec"))
    want = {(r["split"], r["manifold"], r["flow_id"]): r["cloud"] for r in neighbors.neighborhoods(knn.knn_join(points, 6)).collect()}
    got = {(r["split"], r["manifold"], r["flow_id"]): r["cloud"] for r in knn.knn_clouds(points, 6).collect()}
    assert got == want and len(got) == 1500
    few = spark.createDataFrame([(3,), (250,), (250,), (499,)], "flow_id long")
    some = {(r["split"], r["manifold"], r["flow_id"]): r["cloud"] for r in knn.knn_clouds(points, 6, only=few).collect()}
    assert some == {key: cloud for key, cloud in want.items() if key[2] in (3, 250, 499)} and len(some) == 9
    none = knn.knn_clouds(points, 6, only=few.where("flow_id < 0"))
    assert none.isEmpty()


def test_example_bars_search_for_the_chosen_rows_alone(spark, sf_dir, monkeypatch):
    seen = []
    searched = knn._Join.query_packs

    def counted(self, placed):
        packs = searched(self, placed)
        seen.append(sum(len(r["q_ids"]) for r in packs.select("q_ids").collect()))
        return packs

    monkeypatch.setattr(knn._Join, "query_packs", counted)
    assert queries.example_bars(spark, sf_dir).count() > 0
    assert seen == [9]  # three rows, three manifolds


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-8, 0.0), (1e-8, 5.0), (1e18, 0.0), (1e-22, 0.0)])
def test_rough_comparison_loses_no_neighbour(scale, shift):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(701, 15)) * rng.choice([1.0, 1e-3], size=(701, 1)) * scale + shift
    x[100:140] = x[100]
    ids, k = np.arange(701), 9
    q = x[50:250]
    best = knn._Best(ids[50:250], np.ones(200, int), q.ravel(), knn._kth_bound(q, q, k), k)
    best.bound[:20] = np.inf
    for at in range(0, 701, 133):
        part = x[at : at + 133]
        best.meet(ids[at : at + 133], part.ravel(), part.min(axis=0), part.max(axis=0))
    best.settle()
    who, far, found, _ = best.parts[0]
    exact = np.sqrt(sum((q[:, None, j] - x[None, :, j]) ** 2 for j in range(15)))
    order = np.array([np.lexsort((ids, row))[:k] for row in exact])
    assert np.array_equal(found.reshape(200, k), order) and np.array_equal(far.reshape(200, k), np.take_along_axis(exact, order, 1))


def test_cells_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "PACK", 2)
    points = spark.range(40_000).select(
        F.col("id").alias("flow_id"), F.lit("a").alias("split"), F.lit("m").alias("manifold"), F.array(F.rand(1), F.rand(2)).alias("vec")
    )
    join = knn._Join(settle(points), 3, ["split", "manifold"], "flow_id", "vec", 1)
    tree, low, width = join.coarse_trees()["a", "m"]
    # twice the root of the packs, with no upper end
    assert len(low) == len(width) == int(2 * (40_000 / 2) ** 0.5)


def test_approximate_neighbours_have_a_recall_of_90_percent(spark):
    rng = np.random.default_rng(7)
    rows = []
    for m, d in (("C2", 5), ("Network", 15), ("Physical", 2)):
        middle = rng.normal(size=(6, d)) * 3
        for i in range(4000):
            rows.append(Row(flow_id=i, split="train", manifold=m, vec=(middle[i % 6] + rng.normal(size=d)).tolist()))
    points = settle(spark.createDataFrame(rows))
    exact = settle(knn.knn_join(points, 100))
    found = settle(knn.approximate_knn(points, 100, pack=256))
    got = {r["manifold"]: r["recall"] for r in knn.recall(found, exact).collect()}
    assert len(got) == 3 and min(got.values()) >= 0.9, got
    ranks = found.groupBy("split", "manifold", "flow_id").agg(F.max("rank").alias("r"), F.count_distinct("neighbor_id").alias("n"))
    assert ranks.where("r != 99 or n != 100").isEmpty()


def test_approximate_neighbours_of_few_rows_are_exact(spark):
    rows = [Row(flow_id=i, split="test", manifold="C2", vec=[float(i % 3), 1.0]) for i in range(20)]
    points = spark.createDataFrame(rows)
    one = knn.approximate_knn(points, 30).select("flow_id", "neighbor_id", "distance")
    assert one.exceptAll(knn.knn_join(points, 30).select("flow_id", "neighbor_id", "distance")).isEmpty() and one.count() == 400


def test_leaks_are_counted(spark):
    found = spark.createDataFrame([("train", 1, 1), ("train", 1, 2), ("train", 1, 9)], "split string, flow_id long, neighbor_id long")
    split = spark.createDataFrame([(1, "train"), (2, "test")], "flow_id long, split string")
    row = neighbors.leak_check(found, split).first()
    assert (row["neighbors"], row["leaks"], row["unknown"]) == (3, 1, 1)


@pytest.mark.parametrize("step", [1, 13])
def test_frames_equal_plain_window(spark, step):
    rows = spark.range(1000).select(
        (F.col("id") * step + (F.col("id") % step)).alias("flow_id"), (F.col("id") * 37 % 101).cast("double").alias("x")
    )
    got = neighbors.order_neighborhood(rows, "x", block=64).orderBy("flow_id").collect()
    frame = W.orderBy("flow_id").rowsBetween(-25, 24)
    want = (
        rows.select(
            "flow_id",
            F.count(F.lit(1)).over(frame).alias("n_rows"),
            F.min("flow_id").over(frame).alias("first_id"),
            F.max("flow_id").over(frame).alias("last_id"),
            F.avg("x").over(frame).alias("mean_value"),
        )
        .orderBy("flow_id")
        .collect()
    )
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want]


def test_dense_position_with_gaps(spark):
    rows = spark.range(500).select((F.col("id") * F.col("id")).alias("flow_id"))
    got = dense_position(rows, "flow_id").orderBy("flow_id").collect()
    assert [r["pos"] for r in got] == list(range(500))


def test_order_bars_equal_direct_barcodes(spark, sf_dir):
    wide = fx.wide_points(spark, sf_dir).select("flow_id", "C2", "Physical")
    got = topology.order_bars(wide, ["C2", "Physical"], block=40).collect()
    rows = wide.orderBy("flow_id").collect()
    clouds = {m: np.array([r[m] for r in rows]) for m in ("C2", "Physical")}
    place = {r["flow_id"]: i for i, r in enumerate(rows)}
    assert len(got) == 2 * len(rows)
    for r in got[:120]:
        i = place[r["flow_id"]]
        want = barcodes(clouds[r["manifold"]][None, max(0, i - 25) : i + 25])[0]
        assert np.allclose([(b["dim"], b["birth"], b["death"]) for b in r["bars"]], want)


def test_rips_pieces(spark):
    hoods = spark.createDataFrame([(1, [[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [9.0, 9.0]])], "flow_id long, cloud array<array<double>>")
    edges = neighbors.rips_edges(hoods, ["flow_id"]).collect()
    assert sorted((r["i"], r["j"]) for r in edges) == [(0, 1), (0, 2), (1, 2)]
    triples = neighbors.rips_triangles(hoods, ["flow_id"]).collect()
    assert [(r["i"], r["j"], r["l"]) for r in triples] == [(0, 1, 2)]
    assert triples[0]["value"] == pytest.approx(2**0.5)


def test_rips_pieces_of_mixed_clouds(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PIECE_CELLS", 130)
    rng = np.random.default_rng(11)
    clouds = [rng.normal(size=(n, d)).tolist() for n, d in [(1, 2), (2, 2), (7, 2), (7, 5), (12, 2)] * 9] + [[], None]
    hoods = spark.createDataFrame(list(enumerate(clouds)), "flow_id long, cloud array<array<double>>").coalesce(1)
    edges, triples = {}, {}
    for key, cloud in enumerate(clouds):
        p = np.array(cloud or [])
        dist = np.array([[np.sqrt(((a - b) ** 2).sum()) for b in p] for a in p])
        for i, j in itertools.combinations(range(len(p)), 2):
            edges[key, i, j] = dist[i, j]
        for i, j, m in itertools.combinations(range(len(p)), 3):
            triples[key, i, j, m] = max(dist[i, j], dist[i, m], dist[j, m])
    for found, want in ((neighbors.rips_edges(hoods, ["flow_id"], 1.5), edges), (neighbors.rips_triangles(hoods, ["flow_id"], 1.5), triples)):
        got = {tuple(r)[:-1]: r[-1] for r in found.collect()}
        want = {key: x for key, x in want.items() if x <= 1.5}
        assert set(got) == set(want) and len(got) > 100 and all(got[key] == pytest.approx(x) for key, x in want.items())


def test_bar_features_against_numpy(spark):
    bars = [(0, 0.0, 1.0), (0, 0.0, 2.5), (0, 0.0, float("inf")), (1, 1.0, 1.5), (1, 2.0, 2.0)]
    rows = [(1, "C2", bars)]
    df = spark.createDataFrame(rows, "flow_id long, manifold string, bars array<struct<dim int, birth double, death double>>")
    row = features.bar_features(df).first().asDict()
    assert len(row) == 73
    life = np.array([1.0, 2.5, 5.0])
    p = life / life.sum()
    assert row["C2_H0_count"] == 3 and row["C2_H0_max_persistence"] == 5.0
    assert row["C2_H0_std_persistence"] == pytest.approx(life.std())
    assert row["C2_H0_entropy"] == pytest.approx(-(p * np.log(p + 1e-10)).sum())
    assert row["C2_H1_count"] == 1 and row["C2_H1_mean_birth"] == 1.0
    assert row["C2_H2_count"] == 0 and row["Network_H0_count"] == 0


def test_baseline_and_distances(spark, sf_dir):
    wide = fx.wide_points(spark, sf_dir)
    baseline = settle(topology.baseline_bars(wide, n=30))
    assert {r["n_samples"] for r in baseline.collect()} == {30}
    as_flows = baseline.select(F.lit(1).alias("flow_id"), "manifold", "bars")
    zero = distance.w2_distance(as_flows, baseline).collect()
    assert len(zero) == 3 and all(abs(r["distance"]) < 1e-6 for r in zero)
    table = distance.distance_table(
        distance.w2_distance(topology.order_bars(wide), baseline), wide
    )
    assert table.columns == ["flow_id", "label", "c2_distance", "network_distance", "physical_distance"]
    assert table.count() == wide.count()


def test_hash_rank_with_a_hot_key(spark):
    rows = spark.range(900).select(
        F.col("id").alias("flow_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k")
    )
    ranked = hash_rank(rows, ["k"], "flow_id", 1)
    order = W.partitionBy("k").orderBy(F.md5(F.concat(F.lit("1:"), F.col("flow_id").cast("string"))), "flow_id")
    wrong = ranked.withColumn("want", F.row_number().over(order)).where("want <> rank")
    assert wrong.count() == 0


def test_quantiles_with_a_hot_value(spark):
    rows = spark.range(999).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 31 % 997).cast("double")).alias("x")
    )
    values = np.array([r[0] for r in rows.collect()])
    row = exact_quantiles(rows, ["x"], [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    assert [row[f"q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0])))


def test_knn_candidates_are_not_shuffled(spark):
    """In 15 dimensions every pack meets every other: rows must not be sent once per pack met."""
    points = spark.range(3000).select(
        F.col("id").alias("flow_id"), F.lit("a").alias("split"), F.lit("m").alias("manifold"), F.array(*[F.randn(i) for i in range(15)]).alias("vec")
    )
    plan = knn.knn_join(settle(points), 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_rough_distances_lose_no_neighbour_far_from_the_origin(spark, tiny_packs):
    rng = np.random.default_rng(5)
    rows = [Row(flow_id=i, split="a", manifold="m", vec=(1e6 + rng.normal(size=3) * 1e-3).tolist()) for i in range(300)]
    check_knn(spark.createDataFrame(rows), 5)


def test_knn_of_text_ids(spark, tiny_packs):
    rng = np.random.default_rng(6)
    rows = [Row(flow_id=f"f{i % 7}é{i}", split="a", manifold="m", vec=[float(x) for x in rng.integers(0, 3, 2)]) for i in range(200)]
    check_knn(spark.createDataFrame(rows), 5)


def test_components_alone_are_those_of_the_whole_barcode():
    clouds = np.random.default_rng(8).normal(size=(20, 9, 2))
    alone, whole = barcodes(clouds, loops=False), barcodes(clouds)
    assert any((w[:, 0] == 1).any() for w in whole)
    assert all((a == w[w[:, 0] == 0]).all() for a, w in zip(alone, whole))


def test_diagram_summary_computes_barcodes_once(spark):
    hoods = spark.createDataFrame([("a", "m", 1, [[0.0], [1.0]])], "split string, manifold string, flow_id long, cloud array<array<double>>")
    found = features.diagram_summary(topology.cloud_bars(hoods, ["split", "manifold", "flow_id"]))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {r["dim"]: (r["n_bars"], r["mean_bars"], r["mean_life"], r["max_life"]) for r in found.collect()}
    assert rows == {0: (2, 2.0, 3.0, 5.0), 1: (0, 0.0, 0.0, 0.0), 2: (0, 0.0, 0.0, 0.0)}
