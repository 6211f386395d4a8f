"""Flow, score and point tables derived from the given events and embeddings.

The SQL of flows and scores is the same text in both engines. A flow without duration
has rates of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.schema import CLASSES, MANIFOLDS

FLOWS_SQL = """
WITH e AS (
  SELECT event_id, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}
), c AS (
  SELECT *, 1 + event_id % 97 AS tx, (1 + event_id % 97) - (k % (2 + event_id % 97)) AS rx FROM e
)
SELECT event_id AS flow_id,
       concat('192.168.0.', CAST(1 + user_id % 189 AS STRING)) AS src_addr,
       CASE WHEN user_id % 4 = 0 THEN 654 ELSE 9 END AS src_port,
       concat('192.168.0.', CAST(1 + k % 189 AS STRING)) AS dst_addr,
       CASE WHEN k % 4 = 0 THEN 654 ELSE 9 END AS dst_port,
       'UDP' AS protocol, value AS flow_duration_s,
       CAST(tx AS DOUBLE) AS tx_packets, CAST(rx AS DOUBLE) AS rx_packets,
       CAST(tx - rx AS DOUBLE) AS lost_packets,
       CAST(tx * (64 + k) AS DOUBLE) AS tx_bytes, CAST(rx * (64 + k) AS DOUBLE) AS rx_bytes,
       coalesce(tx / nullif(value, 0), 0) AS tx_packet_rate_s,
       coalesce(rx / nullif(value, 0), 0) AS rx_packet_rate_s,
       coalesce(tx * (64 + k) / nullif(value, 0), 0) AS tx_byte_rate_s,
       coalesce(rx * (64 + k) / nullif(value, 0), 0) AS rx_byte_rate_s,
       CAST(64 + k AS DOUBLE) AS mean_packet_size, value / 1000 AS mean_delay_s,
       value / 5000 AS mean_jitter_s,
       coalesce(rx * (64 + k) / nullif(value, 0) / 125, 0) AS throughput_kbps,
       CAST(tx - rx AS DOUBLE) / tx AS packet_drop_rate,
       CAST(1 + k % 5 AS DOUBLE) AS average_hop_count,
       CASE event_type WHEN 'view' THEN 'Normal Traffic' WHEN 'error' THEN 'Blackhole Attack'
            WHEN 'click' THEN 'Flooding Attack' WHEN 'purchase' THEN 'Sybil Attack'
            ELSE 'Wormhole Attack' END AS label
FROM c
"""

SCORED_SQL = """
SELECT flow_id, label,
       flow_duration_s AS c2_distance,
       sqrt(flow_duration_s) * mean_packet_size AS network_distance,
       lost_packets * average_hop_count AS physical_distance,
       CASE WHEN flow_id % 10 < 8 THEN label
            WHEN flow_id % 3 = 0 THEN 'Normal Traffic' ELSE 'Wormhole Attack' END AS predicted
FROM {flows}
"""

# Class weights of a row, normalised to probabilities by the readers.
PROBABILITY_WEIGHTS = [
    f"(1 + (flow_id * {i + 3}) % 17 + CASE WHEN predicted = '{c}' THEN 20 ELSE 0 END)"
    for i, c in enumerate(CLASSES)
]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(FLOWS_SQL, events=events)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORED_SQL, flows=flows(spark, sf_dir))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flow_id, label, predicted, probabilities) in the order of the classes."""
    weights = F.array(*[F.expr(w).cast("double") for w in PROBABILITY_WEIGHTS])
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    return (
        scored(spark, sf_dir)
        .withColumn("_w", weights)
        .withColumn("_t", total)
        .select("flow_id", "label", "predicted", F.transform("_w", lambda x: x / F.col("_t")).alias("probabilities"))
    )


# Components of an embedding that form each manifold (1-based start, length).
SLICES = {"C2": (1, 5), "Network": (6, 15), "Physical": (21, 2)}


def wide_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flow_id, c, split, label, one array per manifold) from the embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vector = F.col("embedding").cast("array<double>")
    mark = F.md5(F.concat(F.lit("42:"), F.col("vec_id").cast("string")))
    return rows.select(
        F.col("vec_id").alias("flow_id"),
        (F.col("label") % 5).alias("c"),
        F.when(mark < "3333", "test").otherwise("train").alias("split"),
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("label") % 5 + 1).cast("int")).alias("label"),
        *[F.slice(vector, *SLICES[m]).alias(m) for m in MANIFOLDS],
    )
