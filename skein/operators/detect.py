"""3-sigma detection on distances to normal traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.columns import any_flag, flag_pattern
from skein.schema import MANIFOLDS, NORMAL, SIGMA
from skein.session import all_rows

GROUPS = [m.lower() for m in MANIFOLDS]


def normal_stats(
    df: DataFrame,
    groups: list[str] = GROUPS,
    normal: str = NORMAL,
    sigma: float = SIGMA,
    label: str = "label",
) -> DataFrame:
    """(manifold, mean, std, threshold) of the normal rows, sample standard deviation."""
    cells = F.array(
        *[
            F.struct(
                F.lit(g).alias("manifold"),
                F.avg(f"{g}_distance").alias("mean"),
                F.stddev_samp(f"{g}_distance").alias("std"),
            )
            for g in groups
        ]
    )
    stats = df.where(F.col(label) == normal).agg(cells.alias("s")).select(F.inline("s"))
    return stats.withColumn("threshold", F.col("mean") + F.lit(sigma) * F.col("std"))


def zscore_detect(df: DataFrame, stats: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """Add z-scores, per-group flags (z > sigma), their union and the pattern text.

    ``stats`` is the fitted table of ``normal_stats``: one row per group. In a group whose normal
    rows have no spread, z is infinite beside the mean and null at it. Flags are never null: a
    row without a z-score is not flagged.
    """
    fitted = {r["manifold"]: r for r in stats.collect()}
    groups = [g for g in GROUPS if g in fitted]
    groups += [g for g in fitted if g not in groups]
    scores = {}
    for g in groups:
        mean, std = fitted[g]["mean"], fitted[g]["std"]
        apart = F.col(f"{g}_distance") - F.lit(mean)
        if std == 0:
            scores[f"{g}_zscore"] = F.when(apart != 0, F.signum(apart) * F.lit(float("inf")))
        else:
            scores[f"{g}_zscore"] = apart / F.lit(std)
    flags = [f"{g}_anomaly" for g in groups]
    return (
        df.withColumns(scores)
        .withColumns({
                f: F.coalesce(F.col(f.replace("_anomaly", "_zscore")) > F.lit(sigma), F.lit(False)) for f in flags
            })
        .withColumn("anomaly_detected", any_flag([F.col(f) for f in flags]))
        .withColumn("pattern", flag_pattern([F.col(f) for f in flags]))
    )


def max_zscore(groups: list[str] = GROUPS):
    """The overall score of a flow: its largest z-score."""
    return F.greatest(*[F.col(f"{g}_zscore") for g in groups])


def detection_summary(df: DataFrame, groups: list[str] = GROUPS, label: str = "label") -> DataFrame:
    """Per class: rows, detected rows, detection rate in %, flags per group."""
    detected = F.count_if("anomaly_detected")
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("total_samples"),
        detected.alias("detected"),
        (detected * 100.0 / F.count(F.lit(1))).alias("detection_rate_pct"),
        *[F.count_if(f"{g}_anomaly").alias(f"{g}_flags") for g in groups],
    )


def flag_rates(df: DataFrame, groups: list[str] = GROUPS) -> DataFrame:
    """Rows flagged and % per group and combined, with the z-score range of each group."""
    names = [(g, f"{g}_anomaly", F.col(f"{g}_zscore")) for g in groups]
    names.append(("combined", "anomaly_detected", max_zscore(groups)))
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("manifold"),
                F.count_if(flag).alias("flagged"),
                (F.avg(F.col(flag).cast("int")) * 100.0).alias("pct"),
                F.min(z).alias("z_min"),
                F.max(z).alias("z_max"),
            )
            for name, flag, z in names
        ]
    )
    return df.agg(cells.alias("c")).select(F.inline("c"))


def pattern_counts(df: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent flag patterns with their share in %."""
    counts = df.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.select("pattern", "n", (F.col("n") * 100.0 / F.sum("n").over(all_rows())).alias("pct"))
        .orderBy(F.desc("n"), "pattern")
        .limit(top)
    )
