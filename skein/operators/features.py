"""Statistics of barcodes as model features, and reports over barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions.columns import bars_of_dim, cap_death, entropy_term
from skein.schema import BAR_STATISTICS, HOMOLOGY_DIMS, MANIFOLDS, MAX_EDGE


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _mean(values: Column, n: Column) -> Column:
    return F.try_divide(_total(values), n)


def _field(bars: Column, name: str) -> Column:
    return F.transform(bars, lambda b: b[name])


def _real_bars(bars: str, dim: int) -> Column:
    """Bars of one dimension that have a positive length."""
    return F.filter(bars, lambda b: (b["dim"] == dim) & (b["life"] > 0))


def _spread(values: Column, mean: Column) -> Column:
    return F.transform(values, lambda x: (x - mean) * (x - mean))


def _entropy(values: Column, total: Column) -> Column:
    return _total(F.transform(values, lambda x: entropy_term(x, total)))


def bar_statistics(bars: DataFrame, keys: list[str], cap: float = MAX_EDGE) -> DataFrame:
    """(keys.., manifold, h<d> struct..) statistics per row of bars.

    A row holds the whole barcode of one neighbourhood, so nothing is exploded or
    shuffled. Bars of length 0 do not count.
    """
    capped = F.transform(
        "bars",
        lambda b: F.struct(
            b["dim"].alias("dim"),
            b["birth"].alias("birth"),
            cap_death(b["death"], cap).alias("death"),
            (cap_death(b["death"], cap) - b["birth"]).alias("life"),
        ),
    )
    out = bars.select(*keys, "manifold", capped.alias("_bars"))
    for d in HOMOLOGY_DIMS:
        out = out.withColumn(f"_d{d}", _real_bars("_bars", d))
        mine = F.col(f"_d{d}")
        life = _field(mine, "life")
        sums = F.struct(F.size(mine).cast("double").alias("n"), _total(life).alias("total"))
        out = out.withColumn(f"_s{d}", sums)
        n, total = F.col(f"_s{d}.n"), F.col(f"_s{d}.total")
        mean = F.try_divide(total, n)
        stats = {
            "count": n,
            "mean_persistence": mean,
            "std_persistence": F.sqrt(_mean(_spread(life, mean), n)),
            "max_persistence": F.array_max(life),
            "total_persistence": total,
            "mean_birth": _mean(_field(mine, "birth"), n),
            "mean_death": _mean(_field(mine, "death"), n),
            "entropy": _entropy(life, total),
        }
        filled = [F.coalesce(stats[s], F.lit(0.0)).alias(s) for s in BAR_STATISTICS]
        out = out.withColumn(f"h{d}", F.struct(*filled))
    return out.select(*keys, "manifold", *[f"h{d}" for d in HOMOLOGY_DIMS])


def bar_features(
    bars: DataFrame,
    keys: list[str] = ("flow_id",),
    manifolds: list[str] = MANIFOLDS,
    cap: float = MAX_EDGE,
) -> DataFrame:
    """(keys.., 72 columns <manifold>_H<d>_<statistic>); a missing manifold gives zeros.

    Only the small statistics rows, one per manifold, are shuffled by key.
    """
    stats = bar_statistics(bars, list(keys), cap)
    columns = [
        F.coalesce(
            F.max(F.when(F.col("manifold") == m, F.col(f"h{d}")[s])), F.lit(0.0)
        ).alias(f"{m}_H{d}_{s}")
        for m in manifolds
        for d in HOMOLOGY_DIMS
        for s in BAR_STATISTICS
    ]
    return stats.groupBy(*keys).agg(*columns)


def diagram_summary(bars: DataFrame, keys: list[str] = ("manifold", "split")) -> DataFrame:
    """(keys.., dim): mean bars per row, mean and longest lifetime of bars longer than 0; a
    dimension without bars has a row of zeros."""
    cells = []
    for d in HOMOLOGY_DIMS:
        life = F.filter(
            F.transform(bars_of_dim(F.col("bars"), d), lambda b: cap_death(b["death"]) - b["birth"]), lambda x: x > 0
        )
        cells.append(F.struct(F.lit(d).alias("dim"), life.alias("life")))
    # one row per row and dimension: the barcodes are computed once
    found = bars.select(*keys, F.inline(F.array(*cells))).groupBy(*keys, "dim").agg(
        F.sum(F.size("life")).alias("n_bars"),
        (F.sum(F.size("life")) / F.count(F.lit(1))).alias("mean_bars"),
        F.try_divide(F.sum(_total(F.col("life"))), F.sum(F.size("life"))).alias("mean_life"),
        F.max(F.array_max("life")).alias("max_life"),
    )
    return found.select(
        *keys, "dim", "n_bars", "mean_bars", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_life", "max_life")]
    )


def diagram_by_class(bars: DataFrame, label: str, keys: list[str] = ("manifold", "split")) -> DataFrame:
    """(keys.., label): mean number of H0 and H1 bars per row of the class."""
    counted = bars.select(
        *keys, label, *[F.size(bars_of_dim(F.col("bars"), d)).alias(f"n{d}") for d in (0, 1)]
    )
    return counted.groupBy(*keys, label).agg(
        F.avg("n0").alias("mean_h0_bars"), F.avg("n1").alias("mean_h1_bars")
    )


def example_bars(bars: DataFrame, chosen: DataFrame, unique: str = "flow_id") -> DataFrame:
    """Bars of chosen rows stacked H0, H1, H2: (id, manifold, position, dim, birth, death)."""
    mine = bars.join(chosen.select(unique), unique, "left_semi").select(
        unique, "manifold", F.inline("bars")
    )
    stack = W.partitionBy(unique, "manifold").orderBy("dim", "birth", "death")
    return mine.withColumn("death", cap_death(F.col("death"))).withColumn(
        "position", F.row_number().over(stack) - 1
    )
