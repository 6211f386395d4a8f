"""Reading flow records and other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.schema import FLOW_SCHEMA, snake


def read_flows_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flow CSV with header and a declared schema; column names become snake_case.

    A file whose header differs from the schema fails instead of shifting columns.
    """
    raw = (
        spark.read.schema(FLOW_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.toDF(*[snake(c) for c in raw.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shape_report(df: DataFrame) -> DataFrame:
    """One row per column: name, type, rows of the table."""
    names = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type"))
            for i, (n, t) in enumerate(df.dtypes)
        ]
    )
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(F.explode(names).alias("c"), "n_rows").select("c.*", "n_rows")
