"""Comparing model metric tables and feature importances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.columns import dimension_of, manifold_of, provenance, strip_suffix
from skein.session import all_rows

#: Decimals of an importance that decide its rank: below them lies the noise of summation order.
RANK_DIGITS = 9

METRICS = ["accuracy", "f1", "auc"]
# Spellings of the metric columns in stored metric tables.
METRIC_NAMES = {
    "Model": "model",
    "Test_Accuracy": "accuracy",
    "Test_F1": "f1",
    "Test_AUC": "auc",
    "Test Accuracy": "accuracy",
    "Test F1 (weighted)": "f1",
    "Test AUC": "auc",
}


def unify_metrics(metrics: DataFrame, kind: str, tag: str | None = None) -> DataFrame:
    """Common column names, a ``type`` column, and model names without their tag."""
    out = metrics.withColumnsRenamed(METRIC_NAMES).withColumn("type", F.lit(kind))
    return out if tag is None else out.withColumn("model", strip_suffix(F.col("model"), tag))


def metrics_union(baseline: DataFrame, enhanced: DataFrame) -> DataFrame:
    return baseline.unionByName(enhanced, allowMissingColumns=True)


def metrics_pivot(metrics: DataFrame, types: list[str], value: str = "accuracy") -> DataFrame:
    """One row per model, one column per type."""
    return metrics.groupBy("model").pivot("type", types).agg(F.first(value))


def model_delta(baseline: DataFrame, enhanced: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Per model: both values, their difference and the difference in % of the baseline."""
    left = baseline.select("model", *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    right = enhanced.select("model", *[F.col(m).alias(f"enhanced_{m}") for m in metrics])
    out = left.join(right, "model")
    for m in metrics:
        delta = F.col(f"enhanced_{m}") - F.col(f"baseline_{m}")
        out = out.withColumn(f"{m}_delta", delta).withColumn(
            f"{m}_delta_pct", F.try_divide(delta, F.col(f"baseline_{m}")) * 100.0
        )
    return out


def mean_delta(delta: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    return delta.agg(*[F.avg(f"{m}_delta_pct").alias(f"{m}_delta_pct") for m in metrics])


def percent_table(delta: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Rounded summary: both values in %, and the relative change."""
    return delta.select(
        "model",
        F.round(F.col(f"baseline_{metric}") * 100, 2).alias("baseline_pct"),
        F.round(F.col(f"enhanced_{metric}") * 100, 2).alias("enhanced_pct"),
        F.round(f"{metric}_delta_pct", 2).alias("improvement_pct"),
    )


def best_model(metrics: DataFrame, by: str = "accuracy") -> DataFrame:
    """Name and value of the best row; equal values resolve to the first name."""
    per_value = metrics.groupBy(by).agg(F.min("model").alias("model"))
    return per_value.agg(F.max_by("model", by).alias("model"), F.max(by).alias(by))


def auc_improvement(baseline: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Per target and for macro / weighted: baseline, enhanced, improvement.

    Both tables have target, auc and n_pos (the rows of the target); the weights are those of the
    baseline table. One row per target.
    """
    left = baseline.select("target", F.col("auc").alias("baseline_auc"), "n_pos")
    right = enhanced.select("target", F.col("auc").alias("enhanced_auc"))
    each = left.join(right, "target")
    sides = ("baseline_auc", "enhanced_auc")
    overall = F.array(
        F.struct(F.lit("macro").alias("target"), *[F.avg(c).alias(c) for c in sides]),
        F.struct(F.lit("weighted").alias("target"), *[(F.sum(F.col(c) * F.col("n_pos")) / F.sum("n_pos")).alias(c) for c in sides]),
    )
    both = each.select("target", *sides).unionByName(each.agg(overall.alias("r")).select(F.inline("r")))
    return both.withColumn("improvement", F.col("enhanced_auc") - F.col("baseline_auc"))


def t_statistic(df: DataFrame, value: str) -> DataFrame:
    """One-sample t statistic of mean = 0 and its sample size."""
    return df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.try_divide(F.avg(value), F.stddev_samp(value) / F.sqrt(F.count(value))).alias("t"),
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with df degrees of freedom."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_test(df: DataFrame, value: str, alpha: float = 0.05) -> dict[str, object]:
    """Two-sided one-sample t-test against 0, from the one-row statistic."""
    row = t_statistic(df, value).first()
    p = None if row["t"] is None else t_two_sided(row["t"], row["n"] - 1)
    return {"n": row["n"], "t": row["t"], "p": p, "significant": p is not None and p < alpha}


def _by_importance(digits: int | None = RANK_DIGITS) -> list[Column]:
    """Features that are multiples of each other are level at this precision and go by name; without
    ``digits``, only equal importances are level."""
    value = F.col("importance") if digits is None else F.round("importance", digits)
    return [F.desc(value), F.col("feature")]


def top_features(importance: DataFrame, k: int = 20, digits: int | None = RANK_DIGITS) -> DataFrame:
    """The k most important features with their provenance; level ones by name."""
    return importance.withColumn("type", provenance(F.col("feature"))).orderBy(*_by_importance(digits)).limit(k)


def importance_groups(importance: DataFrame, top: int = 20) -> DataFrame:
    """Sum, share in % and top-k members per type, manifold and homology dimension."""
    best = importance.orderBy(*_by_importance()).limit(top).select("feature", F.lit(1).alias("t"))
    f = F.col("feature")
    facets = F.array(
        F.struct(F.lit("type").alias("facet"), provenance(f).alias("name")),
        F.struct(F.lit("manifold").alias("facet"), manifold_of(f).alias("name")),
        F.struct(F.lit("dimension").alias("facet"), dimension_of(f).alias("name")),
    )
    tagged = (
        importance.withColumn("total", F.sum("importance").over(all_rows()))
        .join(best, "feature", "left")
        .select("importance", "total", "t", F.inline(facets))
    )
    return tagged.groupBy("facet", "name").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.sum("importance").alias("importance"),
        (F.sum("importance") * 100.0 / F.first("total")).alias("pct"),
        F.count("t").alias("n_top"),
    )
