"""Descriptive reports over flow and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.columns import any_flag
from skein.operators.ranks import exact_quantiles
from skein.schema import KEY_FEATURES, NORMAL
from skein.session import all_rows, settle

SHARE_LIMIT = 95.0
DISTINCT_LIMIT = 100


def long_form(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep.., feature, value): one row per cell."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(*keep, F.inline(cells))


def repeated_rows(df: DataFrame, columns: list[list[str]]) -> DataFrame:
    """For each list of columns, rows equal to an earlier row in all of them: one column
    ``repeats<i>`` each, in one row.

    Rows are grouped by a 128-bit digest first, one narrow shuffle for all lists; a large group of
    copies travels as one row per task. Only rows whose digest occurs twice or more are then
    compared by their values.
    """
    names = ("_digest_list", "_digest_a", "_digest_b")

    def digest(i: int, cols: list[str]) -> list[Column]:
        return [F.lit(i), F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *reversed(cols))]

    each = [F.struct(*[c.alias(n) for c, n in zip(digest(i, cols), names)]) for i, cols in enumerate(columns)]
    met = df.select(F.inline(F.array(*each))).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    again = settle(met.where(F.col("n") > 1).drop("n"))
    found = None
    for i, cols in enumerate(columns):
        # equal digests: usually few, and equal rows are merged before their shuffle
        marked = df.select(*cols, *[c.alias(n) for c, n in zip(digest(i, cols), names)])
        same = marked.join(again, list(names), "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        part = same.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(f"repeats{i}"))
        found = part if found is None else found.crossJoin(part)  # two tables of one row
    return found


def scan_profile(df: DataFrame, unique: str = "flow_id") -> DataFrame:
    """Rows, columns, nulls, rows equal to another row (with and without the id)."""
    nulls = sum(F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_nulls")
    )
    repeats = settle(repeated_rows(df, [df.columns, [c for c in df.columns if c != unique]]))
    return counts.select(
        "n_rows",
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        "n_nulls",
        repeats.select("repeats0").scalar().alias("duplicate_rows"),
        repeats.select("repeats1").scalar().alias("duplicate_records"),
    )


def class_distribution(df: DataFrame, label: str = "label", limit: float = SHARE_LIMIT) -> DataFrame:
    """Rows and % per class, descending; with the imbalance ratio and its warning."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = all_rows()
    most, rows = F.max("n").over(w), F.sum("n").over(w)
    return counts.select(
        label,
        "n",
        (F.col("n") * 100.0 / rows).alias("pct"),
        (most / F.min("n").over(w)).alias("imbalance"),
        (most * 100.0 / rows > limit).alias("imbalanced"),
    ).orderBy(F.desc("n"), label)


def class_means(df: DataFrame, features: list[str] = KEY_FEATURES, label: str = "label") -> DataFrame:
    """Mean of each feature per class, and its ratio to the normal class.

    Means first come out one row per class; only those rows are reshaped.
    """
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in features])
    rows = long_form(means, features, [label])
    normal = rows.where(F.col(label) == NORMAL).select("feature", F.col("value").alias("_normal"))
    return (
        rows.join(normal, "feature", "left")
        .select(
            "feature",
            label,
            F.col("value").alias("mean"),
            F.when(F.col("_normal") > 0, F.col("value") / F.col("_normal")).alias("ratio_to_normal"),
        )
        .orderBy("feature", F.desc("mean"))
    )


def distinct_by_class(
    df: DataFrame,
    features: list[str],
    classes: list[str],
    label: str = "label",
    more_than: int = DISTINCT_LIMIT,
) -> DataFrame:
    """Distinct values per class and in total, for features with more than a limit of them.

    One shuffle on (feature, value); a frequent value is merged map-side.
    """
    seen = [F.max((F.col(label) == c).cast("int")).alias(f"c{i}") for i, c in enumerate(classes)]
    values = long_form(df, features, [label]).groupBy("feature", "value").agg(*seen)
    counts = values.groupBy("feature").agg(
        F.count("value").alias("n_total"),
        *[F.sum(F.when(F.col("value").isNotNull(), F.col(f"c{i}"))).alias(f"c{i}") for i in range(len(classes))],
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias(label), F.col(f"c{i}").alias("n_distinct"))
            for i, c in enumerate(classes)
        ]
    )
    return counts.where(F.col("n_total") > more_than).select("feature", "n_total", F.inline(cells))


#: Bits of a sketch's size; its relative standard error is SKETCH_ERROR / 2 ** (bits / 2).
SKETCH_BITS = 12
SKETCH_ERROR = 1.04


def distinct_sketches(df: DataFrame, features: list[str], label: str = "label", bits: int = SKETCH_BITS) -> DataFrame:
    """(feature, label, sketch): one mergeable sketch of the values of each feature and class, a few
    KB whatever the number of rows. Missing values do not count; no value is shuffled."""
    sketches = df.groupBy(label).agg(*[F.hll_sketch_agg(F.col(c).cast("double").cast("string"), F.lit(bits)).alias(c) for c in features])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("sketch")) for c in features])
    return sketches.select(F.inline(cells), label)


def merge_sketches(*tables: DataFrame, label: str = "label") -> DataFrame:
    """Sketches of several tables (days, say) as if all rows had been in one."""
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    return every.groupBy("feature", label).agg(F.hll_union_agg("sketch").alias("sketch"))


def approx_distinct_by_class(
    sketches: DataFrame, label: str = "label", more_than: int = DISTINCT_LIMIT, bits: int = SKETCH_BITS
) -> DataFrame:
    """As ``distinct_by_class``, from sketches: (feature, n_total, label, n_distinct, error).

    ``error`` is the relative standard error of the estimates; about 997 of 1,000 lie within three
    of them. A class without any row has no line.
    """
    total = sketches.groupBy("feature").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_total"))
    each = sketches.select("feature", label, F.hll_sketch_estimate("sketch").alias("n_distinct"))
    wanted = F.broadcast(total.where(F.col("n_total") > more_than))  # one row a feature
    error = F.lit(SKETCH_ERROR / 2 ** (bits / 2))
    return each.join(wanted, "feature").select("feature", "n_total", label, "n_distinct", error.alias("error"))


def range_overlap(df: DataFrame, features: list[str], target: str, label: str = "label") -> DataFrame:
    """Value range of one class against the rest, and whether the ranges overlap."""
    mine = F.col(label) == target
    aggs = []
    for c in features:
        aggs += [
            F.min(F.when(mine, F.col(c))).alias(f"a0_{c}"),
            F.max(F.when(mine, F.col(c))).alias(f"a1_{c}"),
            F.min(F.when(~mine, F.col(c))).alias(f"b0_{c}"),
            F.max(F.when(~mine, F.col(c))).alias(f"b1_{c}"),
        ]
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"a0_{c}").cast("double").alias("class_min"),
                F.col(f"a1_{c}").cast("double").alias("class_max"),
                F.col(f"b0_{c}").cast("double").alias("rest_min"),
                F.col(f"b1_{c}").cast("double").alias("rest_max"),
            )
            for c in features
        ]
    )
    overlap = (F.col("class_min") <= F.col("rest_max")) & (F.col("rest_min") <= F.col("class_max"))
    return df.agg(*aggs).select(F.inline(cells)).withColumn("overlap", overlap)


def feature_health(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: NaN and Inf cells, all-zero columns, fewest distinct values, mean of means and stds.

    Per feature first, through value counts; a NULL cell counts as NaN.
    """
    cells = long_form(df, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("value"), F.col("n")
    bad = v.isNull() | F.isnan(v)
    distinct = cells.groupBy("feature").agg(
        F.sum(F.when(bad, n).otherwise(0)).alias("nan"),
        F.sum(F.when(F.abs(v) == float("inf"), n).otherwise(0)).alias("inf"),
        F.coalesce(F.bool_and(v == 0), F.lit(False)).alias("zero"),
        F.count(F.when(~bad, v)).alias("n_distinct"),
    )
    moments = df.agg(
        F.array(
            *[
                F.struct(
                    F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).cast("double").alias("std")
                )
                for c in features
            ]
        ).alias("m")
    ).select(F.inline("m"))
    mean_of = moments.agg(F.struct(F.avg("mean").alias("mean"), F.avg("std").alias("std"))).scalar()
    return (
        distinct.agg(
            F.count(F.lit(1)).alias("n_features"),
            F.sum("nan").alias("nan_cells"),
            F.sum("inf").alias("inf_cells"),
            F.count_if("zero").alias("zero_columns"),
            F.min("n_distinct").alias("min_distinct"),
        )
        .withColumn("_m", mean_of)
        .select(
            "n_features",
            "nan_cells",
            "inf_cells",
            "zero_columns",
            "min_distinct",
            F.col("_m.mean").alias("mean_of_means"),
            F.col("_m.std").alias("mean_of_stds"),
        )
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column."""
    moments = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            )
            for c in columns
        ]
    )
    basics = df.agg(moments.alias("m")).select(F.inline("m"))
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "name", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return basics.join(quartiles, "name", "left").select(
        "name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def nth_of_class(
    df: DataFrame, n: int, classes: list[str], label: str = "label", unique: str = "flow_id"
) -> DataFrame:
    """The n-th row (0-based, in id order) of each class; tasks keep only their first n + 1."""
    order = W.partitionBy(label).orderBy(unique)
    ranked = df.where(F.col(label).isin(classes)).withColumn("_rn", F.row_number().over(order))
    return ranked.where(F.col("_rn") == n + 1).drop("_rn")


def exclusive_flags(df: DataFrame, flags: list[str], union: str) -> DataFrame:
    """Rows flagged by exactly one group, by several, and whether the union flag is their OR."""

    def only(name: str) -> Column:
        others = [~F.col(f) for f in flags if f != name]
        out = F.col(name)
        for o in others:
            out = out & o
        return out

    n_set = sum(F.col(f).cast("int") for f in flags)
    return df.agg(
        *[F.count_if(only(f)).alias(f"{f}_only") for f in flags],
        F.count_if(n_set > 1).alias("multiple"),
        F.bool_and(F.col(union) == any_flag([F.col(f) for f in flags])).alias("union_is_or"),
    )

