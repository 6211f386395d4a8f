"""Restartable batches, aligned joins, sketches, digests of rows, positions and hash ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contract import fixtures as fx
from skein.operators import prep, profile, ranks, topology
from skein.plans.supervised import local_bars
from skein.plans.unsupervised import detect_anomalies
from skein.sources.batches import BatchRun


class Stopped(Exception):
    pass


def stopping(work, after):
    """``work`` that fails when it is called once more than ``after`` times."""
    calls = []

    def run(part):
        calls.append(part)
        if len(calls) > after:
            raise Stopped
        return work(part)

    return run


def test_a_stopped_run_computes_only_what_is_missing(spark, tmp_path):
    rows = spark.range(1000).select("id", F.floor(F.col("id") / 50).cast("long").alias("batch"))
    path = str(tmp_path / "run")

    def square(part):
        return part.select("id", (F.col("id") * F.col("id")).alias("square"), "batch")

    first = BatchRun(spark, path, waves=5)
    with pytest.raises(Stopped):
        first.compute("squares", rows, stopping(square, 2))
    done = {r["batch"] for r in first.finished("squares").collect()}
    assert 0 < len(done) < 20
    # what a stopped run wrote without entering it is replaced
    late = min(set(range(20)) - done)
    rows.where(F.col("batch") == late).select("id", F.lit(-1).cast("long").alias("square"), "batch").write.mode("append").partitionBy(
        "batch"
    ).parquet(f"{path}/squares")

    second = BatchRun(spark, path, waves=5)
    got = second.compute("squares", rows, square)
    assert {tuple(r) for r in got.select("id", "square").collect()} == {(i, i * i) for i in range(1000)} and got.count() == 1000
    by_run = {r: set() for r in (first.run, second.run)}
    for r in second.finished("squares").collect():
        by_run[r["run"]].add(r["batch"])
    assert by_run[first.run] == done and by_run[second.run] == set(range(20)) - done

    third = BatchRun(spark, path)
    # one call, for the columns of the result
    assert third.compute("squares", rows, stopping(square, 1)).count() == 1000
    assert third.compute("nothing", rows.limit(0), square).count() == 0


def test_frames_and_plans_take_up_a_stopped_run(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(topology, "BLOCKS_PER_BATCH", 2)
    wide = prep.manifold_vectors(fx.flows(spark, sf_dir).where("flow_id < 600"))
    path = str(tmp_path / "frames")
    run = BatchRun(spark, path, waves=4)
    real = run.compute
    monkeypatch.setattr(run, "compute", lambda stage, rows, work: real(stage, rows, stopping(work, 1)))
    with pytest.raises(Stopped):
        topology.order_bars(wide, ["Physical"], block=50, run=run)
    done = {r["batch"] for r in run.finished("order-bars").collect()}
    again = BatchRun(spark, path, waves=4)
    got = topology.order_bars(wide, ["Physical"], block=50, run=again)
    want = topology.order_bars(wide, ["Physical"], block=50)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 600
    computed = [r["batch"] for r in again.finished("order-bars").where(F.col("run") == again.run).collect()]
    # the halo of the last block reaches into one more
    assert 0 < len(done) < 7 and sorted([*done, *computed]) == list(range(7))
    # the points were written by the first run alone
    assert {r["run"] for r in again.finished("frames").collect()} == {run.run}


def test_plans_with_and_without_a_folder_agree(spark, sf_dir, tmp_path):
    flows = fx.flows(spark, sf_dir).where("flow_id < 300")
    split = prep.stratified_split(flows.select("flow_id", "label"))
    kept = local_bars(flows, split, 6, run=BatchRun(spark, str(tmp_path / "local")))
    plain = local_bars(flows, split, 6)
    keys = ["split", "manifold", "flow_id"]
    assert kept.select(*keys, "bars").exceptAll(plain.select(*keys, "bars")).isEmpty() and kept.count() == plain.count() == 900
    one = detect_anomalies(flows, n_baseline=30, run=BatchRun(spark, str(tmp_path / "detect"))).detections
    two = detect_anomalies(flows, n_baseline=30).detections
    assert one.exceptAll(two).isEmpty() and one.count() == 300


def test_aligned_joins_raise_on_a_missing_row(spark):
    a = spark.range(50).select(F.col("id").alias("flow_id"), (F.col("id") * 2).alias("x"))
    b = spark.range(50).select(F.col("id").alias("flow_id"), (F.col("id") * 3).alias("x"))
    c = spark.range(50).select(F.col("id").alias("flow_id"), F.lit("y").alias("y"))
    rows = prep.join_aligned(a, b, c).orderBy("flow_id").collect()
    assert [tuple(r) for r in rows] == [(i, 2 * i, 3 * i, "y") for i in range(50)]
    for bad in ((a, b.where("flow_id != 7")), (a.where("flow_id != 7"), b), (a, b, c.where("flow_id < 49"))):
        with pytest.raises(Exception, match="not aligned on flow_id"):
            prep.join_aligned(*bad).agg(F.count("*")).collect()
    # a check inside the plan: one full join, no job before it
    plan = prep.join_aligned(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" in plan and "raise_error" in plan


def test_sketches_stay_within_their_error_and_merge(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"),
        F.col("id").alias("wide"), (F.col("id") % 500).alias("some"), F.when(F.col("id") % 7 > 0, F.col("id") % 4).alias("few"),
    )
    features = ["wide", "some", "few"]
    sketches = profile.distinct_sketches(rows, features)
    got = {(r["feature"], r["label"]): r for r in profile.approx_distinct_by_class(sketches, more_than=100).collect()}
    exact = {(r["feature"], r["label"]): r for r in profile.distinct_by_class(rows, features, ["a", "b"], more_than=100).collect()}
    assert set(got) == set(exact) == {(f, c) for f in ("wide", "some") for c in "ab"}
    for key, r in got.items():
        for name in ("n_distinct", "n_total"):
            assert abs(r[name] - exact[key][name]) <= 3 * r["error"] * exact[key][name]
    parts = [profile.distinct_sketches(rows.where(F.col("some") % 2 == day), features) for day in (0, 1)]
    merged = profile.approx_distinct_by_class(profile.merge_sketches(*parts), more_than=100)
    for r in merged.collect():
        assert abs(r["n_distinct"] - exact[r["feature"], r["label"]]["n_distinct"]) <= 3 * r["error"] * exact[r["feature"], r["label"]]["n_distinct"]


def test_repeated_rows_are_counted_by_value(spark, monkeypatch):
    values = [(i % 7, None if i % 3 else i % 2, f"s{i % 5}") for i in range(400)] + [(9, 9, "x")] * 300 + [(1, None, None)]
    rows = spark.createDataFrame(values, "a long, b long, c string")
    want = len(values) - len(set(values)), len(values) - len({v[1:] for v in values})
    assert tuple(profile.repeated_rows(rows, [["a", "b", "c"], ["b", "c"]]).first()) == want
    # rows whose digests clash by chance are told apart by their values
    monkeypatch.setattr(profile.F, "xxhash64", lambda *cols: F.lit(5).cast("long"))
    assert tuple(profile.repeated_rows(rows, [["a", "b", "c"], ["b", "c"]]).first()) == want
    monkeypatch.undo()
    assert tuple(profile.repeated_rows(rows.limit(0), [["a"]]).first()) == (0,)


def test_positions_of_repeated_ids(spark):
    rows = spark.createDataFrame([(1,), (1,), (3,)], "flow_id long")
    assert sorted(r["pos"] for r in ranks.dense_position(rows, "flow_id").collect()) == [0, 1, 2]


def test_hash_ranks_with_more_digits(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("flow_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    want = ranks.hash_rank(rows, ["label"], "flow_id", 1).select("flow_id", "label", "rank", "size").collect()
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 0.1)
    got = ranks.hash_rank(rows, ["label"], "flow_id", 1).select("flow_id", "label", "rank", "size").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert np.array_equal(sorted(r["rank"] for r in got if r["label"] == "a"), np.arange(1, 1668))
