"""Confusion matrices, class metrics, histograms and probability statistics.

All of them reduce to counts per (actual, predicted) or per value in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions.columns import ratio
from skein.operators.ranks import exact_quantiles
from skein.schema import HISTOGRAM_BINS
from skein.session import all_rows, lookup_join


def confusion_long(df: DataFrame, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) of the pairs that occur."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(long: DataFrame, classes: list[str]) -> DataFrame:
    """One row per actual class, one count column per predicted class, zeros included."""
    return (
        long.groupBy("actual").pivot("predicted", classes).agg(F.sum("n")).fillna(0, subset=classes)
    )


def confusion_pct(long: DataFrame) -> DataFrame:
    """Counts as % of their actual class."""
    row = F.sum("n").over(W.partitionBy("actual"))
    return long.select("actual", "predicted", "n", (F.col("n") * 100.0 / row).alias("pct"))


def f_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def per_class_metrics(long: DataFrame) -> DataFrame:
    """(label, precision, recall, f1_score, support); undefined ratios are 0."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.col("n").alias("support"),
            zero.alias("claimed"),
            hit.cast("long").alias("tp"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            zero.alias("support"),
            F.col("n").alias("claimed"),
            zero.alias("tp"),
        ),
    )
    sums = (
        long.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "tp")])
    )
    return (
        sums.withColumn("precision", ratio(F.col("tp"), F.col("claimed")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1_score", f_score(F.col("precision"), F.col("recall")))
        .select("label", "precision", "recall", "f1_score", "support")
    )


def low_recall(metrics: DataFrame, limit: float = 0.5) -> DataFrame:
    """Class metrics with a warning flag and the macro means beside each class."""
    return metrics.select(
        *metrics.columns,
        F.when(F.col("recall") < limit, True).otherwise(False).alias("low_recall"),
        *[F.avg(c).over(all_rows()).alias(f"macro_{c}") for c in ("precision", "recall", "f1_score")],
    )


def weighted_metrics(long: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1."""
    m = per_class_metrics(long)
    w = F.sum("support")

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), w).alias(c)

    return m.agg(
        ratio(F.sum(F.col("recall") * F.col("support")), w).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1_score"),
        w.alias("support"),
    )


def classification_report(long: DataFrame) -> DataFrame:
    """Class rows, then accuracy (repeated in every column), macro avg, weighted avg."""
    m = per_class_metrics(long).withColumn("support", F.col("support").cast("double"))
    cols = ["precision", "recall", "f1_score"]
    w = F.sum("support")
    accuracy = ratio(F.sum(F.col("recall") * F.col("support")), w)
    rows = F.array(
        F.struct(
            F.lit("accuracy").alias("label"),
            *[accuracy.alias(c) for c in cols],
            accuracy.alias("support"),
        ),
        F.struct(
            F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in cols], w.alias("support")
        ),
        F.struct(
            F.lit("weighted avg").alias("label"),
            *[ratio(F.sum(F.col(c) * F.col("support")), w).alias(c) for c in cols],
            w.alias("support"),
        ),
    )
    return m.unionByName(m.agg(rows.alias("r")).select(F.inline("r")))


def binary_confusion(df: DataFrame, truth: Column, flag: Column) -> DataFrame:
    """One row: tn, fp, fn, tp, the four metrics, and the % flagged of each side."""
    counts = df.agg(
        F.count_if(~truth & ~flag).alias("tn"),
        F.count_if(~truth & flag).alias("fp"),
        F.count_if(truth & ~flag).alias("fn"),
        F.count_if(truth & flag).alias("tp"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1_score", f_score(F.col("precision"), F.col("recall")))
        .withColumn("fpr_pct", ratio(fp * 100, fp + tn))
        .withColumn("tpr_pct", ratio(tp * 100, tp + fn))
    )


def histogram(
    df: DataFrame, columns: list[str], group: Column, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width density histogram per (name, group) over its own range.

    The last bin includes the maximum; a single-valued group gets a unit range.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]
    )
    values = df.select(group.alias("grp"), F.inline(cells)).where(F.col("x").isNotNull())
    spans = values.groupBy("name", "grp").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total")
    )
    spans = spans.select(
        "name",
        "grp",
        "total",
        F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"),
        F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"),
    )
    placed = lookup_join(values, spans, ["name", "grp"])
    spot = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = placed.groupBy("name", "grp", F.least(spot, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    n = F.coalesce(F.col("n"), F.lit(0))
    return grid.join(counts, ["name", "grp", "bin"], "left").select(
        "name",
        "grp",
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("left_edge"),
        n.alias("n"),
        (n / (F.col("total") * width)).alias("density"),
    )


def probability_stats(
    df: DataFrame, classes: list[str], probabilities: str = "probabilities", label: str = "label"
) -> DataFrame:
    """Largest probability over all rows ('ALL'), true-class probability per class.

    mean, population std, min, median, max of each; the probability array follows
    the order of ``classes``.
    """
    own = F.coalesce(
        *[F.when(F.col(label) == c, F.col(probabilities)[i]) for i, c in enumerate(classes)]
    )
    top = F.array_max(probabilities)

    def stats(p: str) -> list[Column]:
        return [
            F.count(F.lit(1)).alias("n"),
            F.avg(p).alias("mean"),
            F.stddev_pop(p).alias("std"),
            F.min(p).alias("min"),
            F.max(p).alias("max"),
        ]

    scored = df.select(F.col(label).alias("label"), own.alias("own"), top.alias("top"))
    whole = scored.agg(*stats("top")).select(
        F.lit("ALL").alias("label"),
        "*",
        exact_quantiles(scored, ["top"], [0.5]).select("q0").scalar().alias("median"),
    )
    each = scored.groupBy("label").agg(*stats("own")).withColumn("median", F.lit(None).cast("double"))
    return whole.unionByName(each)
