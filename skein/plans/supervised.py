"""Flows -> split -> neighbours -> barcodes -> 72 + 22 model features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.auc import multiclass_auc
from skein.operators.evaluate import confusion_long, weighted_metrics
from skein.operators.features import bar_features
from skein.operators.models import check_class_order, score_rows
from skein.operators.knn import knn_clouds
from skein.operators.prep import (
    join_aligned,
    long_points,
    manifold_vectors,
    original_features,
    stratified_split,
)
from skein.operators.topology import cloud_bars
from skein.schema import K_NEIGHBORS, MAX_EDGE, SEED, TEST_FRACTION
from skein.session import settle
from skein.sources.batches import BatchRun
from skein.sources.sinks import FLOWS_PER_BATCH


def local_bars(
    flows: DataFrame,
    split: DataFrame,
    k: int = K_NEIGHBORS,
    max_edge: float = MAX_EDGE,
    run: BatchRun | None = None,
) -> DataFrame:
    """(split, manifold, flow_id, bars) of each flow's k nearest neighbours in its own split.

    With a ``run``, the neighbourhoods are kept in its folder, the barcodes are computed in
    batches of flows, and a stopped run is taken up again.
    """
    keys = ["split", "manifold", "flow_id"]

    def hoods() -> DataFrame:
        points = long_points(manifold_vectors(flows, ["flow_id"]))
        return knn_clouds(points.join(split.select("flow_id", "split"), "flow_id"), k)

    if run is None:
        return cloud_bars(hoods(), keys, max_edge)
    rows = run.once("neighbourhoods", hoods)
    each = F.floor(F.col("flow_id") / FLOWS_PER_BATCH).cast("long")
    return run.compute(
        "local-bars", rows.withColumn("batch", each), lambda part: cloud_bars(part, keys, max_edge).withColumn("batch", each)
    )


def feature_table(
    flows: DataFrame,
    k: int = K_NEIGHBORS,
    fraction: float = TEST_FRACTION,
    seed: int = SEED,
    max_edge: float = MAX_EDGE,
    run: BatchRun | None = None,
) -> DataFrame:
    """(flow_id, label, split, 22 raw and 72 topology columns), computed once and settled: models
    and folds read it many times. A flow without a row on any side raises an error."""
    split = settle(stratified_split(flows.select("flow_id", "label"), fraction=fraction, seed=seed))
    bars = local_bars(flows, split, k, max_edge, run)
    raw = original_features(flows, ["flow_id", "label"])
    topo = bar_features(bars, ["flow_id"])
    return settle(join_aligned(raw, split.select("flow_id", F.col("split")), topo))


def compare_models(
    table: DataFrame,
    fits: dict[str, Callable[[DataFrame], object]],
    classes: list[str],
) -> tuple[DataFrame, dict[str, object]]:
    """Fit on the train rows, measure on the test rows: one metric row per model.

    Each model's scored test rows are settled once for the matrix and the AUC.
    """
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    rows, fitted = None, {}
    for name, fit in fits.items():
        model = fit(train)
        check_class_order(model, classes)
        scored = settle(score_rows(model, test, ["flow_id", "label"]))
        weighted = weighted_metrics(confusion_long(scored))
        macro = multiclass_auc(scored, classes).where("target = 'macro'").select("auc")
        row = weighted.select(
            F.lit(name).alias("model"), "accuracy", "precision", "recall", F.col("f1_score").alias("f1")
        ).withColumn("auc", macro.scalar())
        rows = row if rows is None else rows.unionByName(row)
        fitted[name] = model
    return rows, fitted
