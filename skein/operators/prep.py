"""Encoding, scaling, splitting and sampling of flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions.columns import hash_order, last_octet, port_flag, vector
from skein.operators.ranks import hash_rank
from skein.schema import (
    BASELINE_SAMPLE,
    C2_FEATURES,
    MANIFOLD_FEATURES,
    MANIFOLDS,
    N_FOLDS,
    NETWORK_FEATURES,
    NORMAL,
    PHYSICAL_SOURCES,
    SEED,
    TEST_FRACTION,
)
from skein.session import all_rows, lookup_join


def encode_c2(flows: DataFrame, keep: list[str] = ("flow_id",)) -> DataFrame:
    """The five command-and-control features in their fixed order.

    An unknown port gives NULL.
    """
    coded = (
        flows.drop("protocol")
        .withColumn("src_addr_octet", last_octet(F.col("src_addr")))
        .withColumn("dst_addr_octet", last_octet(F.col("dst_addr")))
        .withColumn("src_port_binary", port_flag(F.col("src_port")))
        .withColumn("dst_port_binary", port_flag(F.col("dst_port")))
    )
    return coded.select(*keep, *C2_FEATURES)


def original_features(flows: DataFrame, keep: list[str] = ("flow_id", "label")) -> DataFrame:
    """The 22 raw features of all three groups, one row per flow."""
    wanted = [*keep, *NETWORK_FEATURES]
    coded = encode_c2(flows, keep=[*wanted])
    physical = [F.col(src).alias(name) for name, src in PHYSICAL_SOURCES.items()]
    return coded.select(*keep, *C2_FEATURES, *NETWORK_FEATURES, *physical)


def encoded_ranges(flows: DataFrame) -> DataFrame:
    """Octet ranges and the sorted distinct ports of both ends."""
    return flows.agg(
        F.min(last_octet(F.col("src_addr"))).alias("src_octet_min"),
        F.max(last_octet(F.col("src_addr"))).alias("src_octet_max"),
        F.min(last_octet(F.col("dst_addr"))).alias("dst_octet_min"),
        F.max(last_octet(F.col("dst_addr"))).alias("dst_octet_max"),
        F.sort_array(F.collect_set("src_port")).alias("src_ports"),
        F.sort_array(F.collect_set("dst_port")).alias("dst_ports"),
    )


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std) with the population standard deviation, in one pass."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")
            )
            for c in columns
        ]
    )
    return df.agg(*aggs).select(F.inline(entries))


def standardise(value: Column, mean: float, std: float) -> Column:
    """(x - mean) / std; a constant column is only centred."""
    return (value - F.lit(mean)) / F.lit(std if std else 1.0)


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Replace each fitted column by its standardised value.

    The fitted table has one row per column of ``df``.
    """
    fitted = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}
    return df.withColumns({c: standardise(F.col(c), m, s) for c, (m, s) in fitted.items()})


def manifold_vectors(flows: DataFrame, keep: list[str] = ("flow_id", "label")) -> DataFrame:
    """Wide table (keep.., one array column per manifold) of scaled features."""
    raw = original_features(flows, keep)
    columns = [c for group in MANIFOLD_FEATURES.values() for c in group]
    scaled = apply_scaler(raw, fit_scaler(raw, columns))
    return scaled.select(*keep, *[vector(cols).alias(m) for m, cols in MANIFOLD_FEATURES.items()])


def long_points(wide: DataFrame, manifolds: list[str] = MANIFOLDS) -> DataFrame:
    """One row per (row, manifold): the other columns, manifold, vec."""
    keep = [c for c in wide.columns if c not in manifolds]
    cells = F.array(
        *[F.struct(F.lit(m).alias("manifold"), F.col(m).alias("vec")) for m in manifolds]
    )
    return wide.select(*keep, F.inline(cells))


def scale_vectors(points: DataFrame, group: str = "manifold", vec: str = "vec") -> DataFrame:
    """Standardise array vectors per group and component.

    One row per (group, component) is fitted; groups are the feature groups, so the
    fitted table stays as small as the number of features.
    """
    stats = (
        points.select(group, F.posexplode(vec).alias("i", "x"))
        .groupBy(group, "i")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("i", "mean", "std"))).alias("_fit"))
    )
    joined = lookup_join(points, stats, [group])
    scaled = F.zip_with(
        vec, "_fit", lambda x, s: (x - s["mean"]) / F.when(s["std"] == 0, 1.0).otherwise(s["std"])
    )
    return joined.withColumn(vec, scaled).drop("_fit").select(*points.columns)


def split_allocation(counts: DataFrame, label: str, fraction: float = TEST_FRACTION) -> DataFrame:
    """(label, n, n_test): ceil(fraction * total) test rows by largest remainder.

    ``counts`` has one row per class, so the windows below see only those few rows.
    """
    everything = all_rows()
    wide = counts.select(label, "n", F.sum("n").over(everything).cast("decimal(38,0)").alias("total"))
    want = F.ceil(F.lit(fraction) * F.col("total").cast("double")).cast("decimal(19,0)")
    share = F.col("want") * F.col("n").cast("decimal(19,0)")
    floors = wide.withColumn("want", want).select(
        label,
        "n",
        "want",
        F.floor(share / F.col("total")).cast("long").alias("base"),
        (share % F.col("total")).alias("rest"),
    )
    order = W.partitionBy().orderBy(F.desc("rest"), F.col(label))
    left = F.col("want").cast("long") - F.sum("base").over(everything)
    return floors.select(
        label,
        "n",
        (F.col("base") + (F.row_number().over(order) <= left).cast("long")).alias("n_test"),
    )


def stratified_split(
    df: DataFrame,
    label: str = "label",
    unique: str = "flow_id",
    fraction: float = TEST_FRACTION,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` ('train' / 'test'): the first rows of each class in hash order are test."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    allocation = split_allocation(counts, label, fraction).select(label, "n_test")
    ranked = lookup_join(hash_rank(df, [label], unique, seed), allocation, [label])
    split = F.when(F.col("rank") <= F.col("n_test"), "test").otherwise("train")
    return ranked.withColumn("split", split).drop("rank", "size", "n_test")


def stratified_folds(
    df: DataFrame,
    n_folds: int = N_FOLDS,
    label: str = "label",
    unique: str = "flow_id",
    seed: int = SEED,
) -> DataFrame:
    """Add ``fold``: rows of each class are dealt out in hash order."""
    ranked = hash_rank(df, [label], unique, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % n_folds).cast("int")).drop("rank", "size")


def select_split(df: DataFrame, split: DataFrame, name: str, unique: str = "flow_id") -> DataFrame:
    """Rows of ``df`` whose id lies in the named split."""
    return df.join(split.where(F.col("split") == name).select(unique), unique, "left_semi")


def split_overlap(split: DataFrame, flows: DataFrame, unique: str = "flow_id") -> DataFrame:
    """Counts that must be 0: ids in both splits, flows in none, split rows without a flow.

    One shuffle by id instead of an intersection and two differences.
    """
    sides = split.select(
        unique,
        (F.col("split") == "train").cast("int").alias("train"),
        (F.col("split") == "test").cast("int").alias("test"),
        F.lit(0).alias("flow"),
    ).unionByName(
        flows.select(unique, F.lit(0).alias("train"), F.lit(0).alias("test"), F.lit(1).alias("flow"))
    )
    per_id = sides.groupBy(unique).agg(*[F.sum(c).alias(c) for c in ("train", "test", "flow")])
    assigned = F.col("train") + F.col("test")
    zero = F.lit(0).cast("long")
    counts = per_id.agg(
        F.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("in_both"),
        F.coalesce(F.sum(F.greatest(F.col("flow") - assigned, zero)), zero).alias("unassigned"),
        F.coalesce(F.sum(F.greatest(assigned - F.col("flow"), zero)), zero).alias("unknown"),
    )
    rows = [
        F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("in_both", "unassigned", "unknown")
    ]
    return counts.select(F.inline(F.array(*rows)))


def split_report(split: DataFrame, label: str = "label") -> DataFrame:
    """Per class: rows and % of its total, train and test table."""
    counts = split.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    shares = [
        (F.col(c) * 100.0 / F.sum(c).over(all_rows())).alias(c.replace("n_", "pct_"))
        for c in ("n_total", "n_train", "n_test")
    ]
    return counts.select(label, "n_total", "n_train", "n_test", *shares)


def baseline_sample(
    df: DataFrame,
    n: int = BASELINE_SAMPLE,
    normal: str = NORMAL,
    unique: str = "flow_id",
    label: str = "label",
    seed: int = SEED,
) -> DataFrame:
    """n rows of the normal class in hash order, or all of them; each task keeps its own n best."""
    key = hash_order(F.col(unique), seed)
    return df.where(F.col(label) == normal).orderBy(key, unique).limit(n)


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_index) of the sorted distinct labels; one row per class."""
    names = df.select(label).distinct()
    order = W.partitionBy().orderBy(label)
    return names.select(label, (F.row_number().over(order) - 1).alias("label_index"))


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return lookup_join(df, label_index(df, label), [label])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight) = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = all_rows()
    weight = F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def join_features(*tables: DataFrame, on: str = "flow_id") -> DataFrame:
    """Put the columns of several tables side by side by row id."""
    out = tables[0]
    for table in tables[1:]:
        repeated = [c for c in table.columns if c in out.columns and c != on]
        out = out.join(table.withColumnsRenamed({c: f"{c}_2" for c in repeated}), on)
    return out


def join_aligned(*tables: DataFrame, on: str = "flow_id") -> DataFrame:
    """As ``join_features``, but a row without a partner in any table raises an error, in the same
    pass: a full join whose filter fails on a missing side."""
    out = tables[0]
    for number, table in enumerate(tables[1:], 2):
        repeated = [c for c in table.columns if c in out.columns and c != on]
        left = out.withColumn("_left", F.lit(True))
        right = table.withColumnsRenamed({c: f"{c}_2" for c in repeated}).withColumn("_right", F.lit(True))
        problem = F.concat(F.lit(f"table {number} is not aligned on {on}: "), F.coalesce(F.col(on).cast("string"), F.lit("null")))
        whole = F.col("_left").isNotNull() & F.col("_right").isNotNull()
        out = left.join(right, on, "full").where(F.when(whole, True).otherwise(F.raise_error(problem).cast("boolean"))).drop("_left", "_right")
    return out


def alignment_report(left: DataFrame, right: DataFrame, on: str = "flow_id") -> DataFrame:
    """Rows of both tables and ids that lack a partner."""
    tagged = left.select(on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(on, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_id = tagged.groupBy(on).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_id.agg(
        F.sum("l").alias("left_rows"),
        F.sum("r").alias("right_rows"),
        F.count_if(F.col("r") == 0).alias("left_only"),
        F.count_if(F.col("l") == 0).alias("right_only"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated_ids"),
    )


def require_aligned(left: DataFrame, right: DataFrame, on: str = "flow_id") -> None:
    """Raise unless both tables hold exactly the same ids, each once."""
    r = alignment_report(left, right, on).first()
    if r["left_only"] or r["right_only"] or r["repeated_ids"] or not r["left_rows"]:
        raise ValueError(f"tables are not aligned on {on}: {r.asDict()}")


def prep_summary(flows: DataFrame, label: str = "label") -> DataFrame:
    """One row: flows, dimensions per manifold, number and list of classes."""
    return flows.agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.count_distinct(label).alias("n_classes"),
        F.sort_array(F.collect_set(label)).alias("classes"),
    ).select(
        "n_flows",
        *[F.lit(len(cols)).alias(f"{m.lower()}_dims") for m, cols in MANIFOLD_FEATURES.items()],
        "n_classes",
        F.concat_ws("|", "classes").alias("classes"),
    )
