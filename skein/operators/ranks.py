"""Global order without a single-task sort: running totals, ranks, quantiles.

Rows are first cut into ordered buckets. Only bucket totals, a few numbers per
bucket, pass through an ordered window over the whole order; inside a bucket the
window runs in parallel with all other buckets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions.columns import hash_order
from skein.session import shuffle_partitions

BUCKET = "_bucket"
HASH = "_hash"
#: Rows of one bucket of hash ranks; more rows mean more leading digits of the hash.
ROWS_PER_BUCKET = 100_000


def cut_points(df: DataFrame, columns: list[str], n: int | None = None) -> dict[str, list[float]]:
    """About n equal-count cuts per column, from one pass without a shuffle of rows.

    Any cuts give exact results downstream; they only decide the balance.
    """
    n = n or shuffle_partitions(df.sparkSession)
    if n < 2:
        return {c: [] for c in columns}
    shares = [i / n for i in range(1, n)]
    row = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), shares, 20 * n).alias(c) for c in columns]
    ).first()
    return {c: sorted({x for x in (row[c] or []) if x == x}) for c in columns}


def with_order_bucket(df: DataFrame, column: str, cuts: list[float], out: str = BUCKET) -> DataFrame:
    """Number of the ordered bucket of ``column``; larger values never get a smaller one."""
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *cuts, float("inf")]
    cast = f"{out}_in"
    return (
        Bucketizer(splits=splits, inputCol=cast, outputCol=out, handleInvalid="keep")
        .transform(df.withColumn(cast, F.col(column).cast("double")))
        .drop(cast)
    )


def bucketed_totals(
    df: DataFrame, keys: list[str], order: list[Column], values: list[str], bucket: str = BUCKET
) -> DataFrame:
    """Add ``<v>_before`` (total of the rows ahead, per key) and ``<v>_total`` per value.

    ``df`` carries the bucket column. The join on (keys, bucket) and the window use
    the same hash partitioning, so the rows are shuffled once.
    """
    spread = [*keys, bucket]
    per_bucket = df.groupBy(*spread).agg(*[F.sum(v).alias(v) for v in values])
    ahead = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_bucket.select(
        *spread,
        *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"_{v}_off") for v in values],
        *[F.sum(v).over(whole).alias(f"{v}_total") for v in values],
    )
    inside = W.partitionBy(*spread).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(offsets, spread)
    for v in values:
        running = F.coalesce(F.sum(v).over(inside), F.lit(0))
        joined = joined.withColumn(f"{v}_before", F.col(f"_{v}_off") + running)
    return joined.drop(*[f"_{v}_off" for v in values])


def dense_position(df: DataFrame, column: str, out: str = "pos") -> DataFrame:
    """0-based row position in ascending order of an integer column.

    Equal values get neighbouring positions in no particular order, so positions are always
    0 .. rows - 1.
    """
    cuts = cut_points(df, [column])[column]
    staged = with_order_bucket(df.withColumn("_one", F.lit(1).cast("long")), column, cuts)
    ranked = bucketed_totals(staged, [], [F.col(column)], ["_one"])
    return ranked.withColumn(out, F.col("_one_before")).drop(BUCKET, "_one", "_one_before", "_one_total")


def hash_rank(
    df: DataFrame, keys: list[str], unique: str, seed: int, out: str = "rank", size: str = "size"
) -> DataFrame:
    """1-based rank in hash order per key, plus the size of the key's group.

    The leading hash digits spread even a hot key evenly over buckets, whose number grows with
    the rows.
    """
    digits, rows = 3, df.count()
    while ROWS_PER_BUCKET * 16**digits < rows:
        digits += 1
    staged = (
        df.withColumn(HASH, hash_order(F.col(unique), seed))
        .withColumn(BUCKET, F.substring(HASH, 1, digits))
        .withColumn("_one", F.lit(1).cast("long"))
    )
    ranked = bucketed_totals(staged, keys, [F.col(HASH), F.col(unique)], ["_one"])
    return (
        ranked.withColumn(out, F.col("_one_before") + 1)
        .withColumn(size, F.col("_one_total"))
        .drop(HASH, BUCKET, "_one", "_one_before", "_one_total")
    )


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(name, q<i>...) per column, linear interpolation between order statistics.

    Works on value counts, so repeated values never pile up, and no task holds
    all values of a column.
    """
    cuts = cut_points(df, columns)
    staged = df
    for c in columns:
        staged = with_order_bucket(staged, c, cuts[c], out=f"_b_{c}")
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("name"),
                    F.col(c).cast("double").alias("value"),
                    F.col(f"_b_{c}").alias(BUCKET),
                )
                for c in columns
            ]
        )
    ).alias("p")
    counts = (
        staged.select(pairs)
        .select("p.*")
        .where(F.col("value").isNotNull())
        .groupBy("name", BUCKET, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = bucketed_totals(counts, ["name"], [F.col("value")], ["n"])
    aggs = []
    for i, q in enumerate(shares):
        spot = F.lit(q) * (F.col("n_total") - 1)
        for part, index in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"_{part}{i}"))
    found = ranked.groupBy("name").agg(F.first("n_total").alias("n"), *aggs)
    out = [F.col("name"), F.col("n")]
    for i, q in enumerate(shares):
        spot = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(f"q{i}"))
    return found.select(*out)
