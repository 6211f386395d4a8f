"""Writing tables, labelled matrices, bars, restartable batches and run metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import compute_partitions

FLOWS_PER_BATCH = 10_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_split(df: DataFrame, path: str) -> None:
    """A table with a ``split`` column; readers of one split prune the other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_bars(df: DataFrame, path: str) -> None:
    """Bars in one folder per manifold (and split, where there is one)."""
    keys = [c for c in ("manifold", "split") if c in df.columns]
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """A labelled matrix as CSV; the row label is an ordinary first column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str, label: str = "actual") -> DataFrame:
    """Read a labelled matrix back: the label as text, every count as a long."""
    text = spark.read.option("header", True).csv(path)
    return text.select(label, *[F.col(f"`{c}`").cast("long").alias(c) for c in text.columns if c != label])


def write_batches(
    df: DataFrame, path: str, flow_id: str = "flow_id", batch_size: int = FLOWS_PER_BATCH
) -> None:
    """Write by batches of flow ids so that a rerun replaces only the batches it computed.

    Files of a batch are split by a hash of the id, so one large batch is not one task.
    """
    batch = F.floor(F.col(flow_id) / batch_size).cast("long")
    spread = F.pmod(F.xxhash64(F.col(flow_id)), F.lit(4))
    n = compute_partitions(df.sparkSession)
    (
        df.withColumn("batch", batch)
        .repartition(n, "batch", spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def missing_batches(
    df: DataFrame, written: DataFrame, flow_id: str = "flow_id", batch_size: int = FLOWS_PER_BATCH
) -> DataFrame:
    """Rows whose batch is not yet in the written table: the rest of a stopped run."""
    done = written.select("batch").distinct()
    batch = F.floor(F.col(flow_id) / batch_size).cast("long")
    return df.withColumn("batch", batch).join(done, "batch", "left_anti").drop("batch")


def run_metadata(df: DataFrame, params: dict[str, object], seconds: float | None = None) -> DataFrame:
    """One row: parameters, row count, run time, time of writing."""
    pairs = [F.lit(str(x)) for kv in sorted(params.items()) for x in kv]
    return df.agg(F.count(F.lit(1)).alias("n_samples")).select(
        "n_samples",
        F.create_map(*pairs).alias("params"),
        F.lit(seconds).cast("double").alias("seconds"),
        F.try_divide(F.col("n_samples").cast("double"), F.lit(seconds).cast("double")).alias("per_second"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
    )


def throughput(df: DataFrame, seconds: float, larger: int, smaller: int) -> DataFrame:
    """One row: rows, run time, rows a second, and how many times more points the larger of two
    kinds of neighbourhood has."""
    return df.agg(F.count(F.lit(1)).alias("n_samples")).select(
        "n_samples",
        F.lit(seconds).cast("double").alias("seconds"),
        F.try_divide(F.col("n_samples").cast("double"), F.lit(seconds).cast("double")).alias("per_second"),
        F.lit(larger / smaller).alias("size_ratio"),
    )
