"""Reading and writing."""

import pytest
from pyspark.sql import functions as F

from contract import fixtures as fx
from skein.operators import evaluate, prep
from skein.schema import FLOW_SCHEMA, snake
from skein.session import lookup_join
from skein.sources import flows, sinks


def test_csv_round_trip(spark, sf_dir, tmp_path):
    rows = fx.flows(spark, sf_dir)
    names = {snake(c): c for c in FLOW_SCHEMA.fieldNames()}
    path = str(tmp_path / "flows")
    rows.select(*[F.col(c).alias(names[c]) for c in (snake(n) for n in FLOW_SCHEMA.fieldNames())]).write.option(
        "header", True
    ).csv(path)
    back = flows.read_flows_csv(spark, path)
    assert [f.dataType for f in back.schema] == [f.dataType for f in FLOW_SCHEMA]
    columns = back.columns
    assert back.exceptAll(rows.select(*[F.col(c).cast(back.schema[c].dataType) for c in columns])).count() == 0
    assert back.count() == rows.count()
    report = flows.shape_report(back).collect()
    assert len(report) == 23 and {r["n_rows"] for r in report} == {1000}


def test_wrong_header_fails(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([(1, "x")], "FlowID long, Other string").write.option("header", True).csv(path)
    with pytest.raises(Exception):
        flows.read_flows_csv(spark, path).collect()


def test_tables_and_matrix(spark, sf_dir, tmp_path):
    rows = fx.scored(spark, sf_dir)
    sinks.write_table(rows, str(tmp_path / "t"))
    assert flows.read_table(spark, str(tmp_path / "t")).count() == 1000
    sinks.write_table(rows, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == rows.columns
    matrix = evaluate.confusion_matrix(evaluate.confusion_long(rows), ["Normal Traffic", "Wormhole Attack"])
    sinks.write_matrix(matrix, str(tmp_path / "m"))
    assert sinks.read_matrix(spark, str(tmp_path / "m")).exceptAll(matrix).count() == 0


def test_split_and_bars_are_partitioned(spark, sf_dir, tmp_path):
    split = prep.stratified_split(fx.flows(spark, sf_dir).select("flow_id", "label"))
    sinks.write_split(split, str(tmp_path / "s"))
    test = spark.read.parquet(str(tmp_path / "s")).where("split = 'test'")
    assert test.count() == 200
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()
    bars = spark.createDataFrame(
        [(1, "C2", "train", [(0, 0.0, 1.0)])],
        "flow_id long, manifold string, split string, bars array<struct<dim int, birth double, death double>>",
    )
    sinks.write_bars(bars, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("manifold = 'C2'").count() == 1


def test_batches_restart(spark, tmp_path):
    path = str(tmp_path / "batches")
    rows = spark.range(1, 101).select(F.col("id").alias("flow_id"), F.lit(1).alias("v"))
    sinks.write_batches(rows.where("flow_id < 50"), path, batch_size=10)
    left = sinks.missing_batches(rows, spark.read.parquet(path), batch_size=10)
    assert left.agg(F.min("flow_id")).first()[0] == 50
    sinks.write_batches(left, path, batch_size=10)
    assert spark.read.parquet(path).count() == 100
    sinks.write_batches(rows.where("flow_id between 20 and 29").withColumn("v", F.lit(2)), path, batch_size=10)
    done = spark.read.parquet(path)
    assert done.count() == 100 and done.where("v = 2").count() == 10


def test_metadata_and_alignment(spark, sf_dir):
    rows = fx.flows(spark, sf_dir)
    meta = sinks.run_metadata(rows, {"k": 100, "max_edge": 5.0}, seconds=2.0).first()
    assert meta["params"] == {"k": "100", "max_edge": "5.0"} and meta["per_second"] == 500.0
    prep.require_aligned(rows, rows.select("flow_id"))
    with pytest.raises(ValueError):
        prep.require_aligned(rows, fx.wide_points(spark, sf_dir))
    with pytest.raises(ValueError):
        prep.require_aligned(rows.where("false"), rows.where("false"))


def test_lookup_is_broadcast_only_when_small(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 10)
    small = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hinted = lookup_join(big, small, ["k"])
    plain = lookup_join(big, small, ["k"], max_rows=5)
    assert "ResolvedHint (strategy=broadcast)" in hinted._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plain._jdf.queryExecution().analyzed().toString()
    assert hinted.exceptAll(plain).count() == 0
