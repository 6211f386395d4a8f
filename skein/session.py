"""Session settings, lineage cuts and size-checked lookups."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

LOOKUP_ROWS = 100_000


def local_session(name: str = "skein", cpus: str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose tasks run
    in the driver's own process may fall back to a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def all_rows() -> WindowSpec:
    """A window over a whole table: only for tables already reduced to a few rows,
    such as one row per class. It avoids computing what led to them a second time."""
    return W.partitionBy()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def compute_partitions(spark: SparkSession) -> int:
    """Partition count for jobs that are small in bytes but heavy in work.

    Given explicitly to ``repartition`` so that adaptive coalescing, which only
    looks at bytes, does not squeeze them into a few tasks.
    """
    return max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism)


def lookup_join(
    df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Join a lookup table; it is broadcast only once its row count is proven small."""
    rows = small.take(max_rows + 1)
    if len(rows) > max_rows:
        return df.join(small, on, how)
    proven = df.sparkSession.createDataFrame(rows, small.schema)
    return df.join(F.broadcast(proven), on, how)
