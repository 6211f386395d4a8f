"""Barcodes of neighbourhoods, computed by Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.barcode import barcodes, bars_of, frame_distances
from skein.functions.columns import bars_of_dim, cap_death
from skein.operators.neighbors import BLOCK, halo_blocks
from skein.operators.prep import baseline_sample, long_points
from skein.operators.ranks import dense_position
from skein.schema import (
    BARS_TYPE,
    BASELINE_SAMPLE,
    FRAME_AFTER,
    FRAME_BEFORE,
    HOMOLOGY_DIMS,
    MANIFOLDS,
    MAX_EDGE,
    NORMAL,
    SEED,
)
from skein.session import compute_partitions
from skein.sources.batches import BatchRun

# Floats of one distance tensor handed to the kernel at a time (64 MB).
TENSOR = 8_000_000
#: Blocks of row-order frames that a restartable run computes as one batch.
BLOCKS_PER_BATCH = 20


def _bars_array(found: list[np.ndarray]) -> pa.Array:
    """Barcodes as an Arrow list<struct<dim, birth, death>> column."""
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in found])]).astype(np.int32)
    rows = np.concatenate(found) if found else np.empty((0, 3))
    values = pa.StructArray.from_arrays(
        [pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(rows[:, 2])],
        names=["dim", "birth", "death"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _list_rows(column: pa.ListArray):
    """Row i of a list column as a numpy array, without copying."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return lambda i: values[ends[i] : ends[i + 1]]


def _by_shape(clouds: list[np.ndarray], max_edge: float, loops: bool = True) -> list[np.ndarray]:
    """Barcodes of clouds of mixed shapes, equal shapes together."""
    found: list[np.ndarray] = [np.empty((0, 3))] * len(clouds)
    shapes: dict[tuple, list[int]] = {}
    for i, cloud in enumerate(clouds):
        shapes.setdefault(cloud.shape, []).append(i)
    for shape, members in shapes.items():
        step = max(1, TENSOR // max(1, shape[0] ** 2))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            for i, bars in zip(part, barcodes(np.stack([clouds[i] for i in part]), max_edge, loops)):
                found[i] = bars
    return found


def cloud_bars(hoods: DataFrame, keys: list[str], max_edge: float = MAX_EDGE, loops: bool = True) -> DataFrame:
    """(keys.., bars) of each row's ``cloud`` (array of points); without ``loops``, H0 alone.

    Points go to Python as one flat array per row.
    """
    flat = hoods.select(
        *keys, F.size("cloud").alias("_n"), F.flatten("cloud").alias("_flat")
    )
    schema = T.StructType([*[hoods.schema[k] for k in keys], T.StructField("bars", BARS_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_n").to_numpy()
            lists = batch.column("_flat")
            numbers = lists.values.to_numpy()
            bounds = lists.offsets.to_numpy()
            clouds = [
                numbers[bounds[i] : bounds[i + 1]].reshape(n, -1) if n > 0 else np.empty((0, 1))
                for i, n in enumerate(sizes)
            ]
            bars = _bars_array(_by_shape(clouds, max_edge, loops))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], bars], names=[*keys, "bars"]
            )

    return flat.mapInArrow(run, schema)


def order_bars(
    wide: DataFrame,
    manifolds: list[str] = MANIFOLDS,
    unique: str = "flow_id",
    before: int = FRAME_BEFORE,
    after: int = FRAME_AFTER,
    block: int = BLOCK,
    max_edge: float = MAX_EDGE,
    run: BatchRun | None = None,
) -> DataFrame:
    """(id, manifold, bars) of the row-order frame of every row.

    ``wide`` has one array column per manifold. A task gets one block of rows
    with its halo and forms the overlapping frames itself, so points are shipped
    about once instead of once per frame. With a ``run``, blocks are computed in its
    batches and a rerun computes only what is missing.
    """

    def placed() -> DataFrame:
        rows = dense_position(wide.select(unique, *manifolds), unique)
        return long_points(halo_blocks(rows, "pos", before, after, block), manifolds)

    def bars(long: DataFrame) -> DataFrame:
        return _frame_bars(long, unique, before, after, max_edge)

    if run is None:
        return bars(placed()).drop("block")
    rows = run.once("frames", placed)
    each = F.floor(F.col("block") / BLOCKS_PER_BATCH).cast("long")
    return run.compute("order-bars", rows.withColumn("batch", each), lambda part: bars(part).withColumn("batch", each)).drop("block")


def _frame_bars(long: DataFrame, unique: str, before: int, after: int, max_edge: float) -> DataFrame:
    """(id, manifold, block, bars) of the owned rows of each block."""
    schema = T.StructType(
        [
            long.schema[unique],
            T.StructField("manifold", T.StringType()),
            T.StructField("block", T.LongType()),
            T.StructField("bars", BARS_TYPE),
        ]
    )

    width = before + after + 1

    def frames(table: pa.Table) -> pa.Table:
        table = table.sort_by([("manifold", "ascending"), ("pos", "ascending")])
        vecs = table.column("vec").combine_chunks()
        lists = _list_rows(vecs)
        names = table.column("manifold").combine_chunks().dictionary_encode().indices.to_numpy()
        owned = np.flatnonzero(table.column("owned").to_numpy())
        bars: list[np.ndarray] = [np.empty((0, 3))] * len(table)
        whole, parts = [], []
        for name in range(names[-1] + 1):
            first, end = np.searchsorted(names, [name, name + 1])
            cloud = np.stack([lists(i) for i in range(first, end)])
            mine = owned[(owned >= first) & (owned < end)] - first
            inside = (mine >= before) & (mine + after < len(cloud))
            whole.append((first, cloud, mine[inside]))
            parts += [(first + i, cloud[max(0, i - before) : i + after + 1]) for i in mine[~inside]]
        # frames of all manifolds side by side, some rows of the block at a time
        step = max(1, TENSOR // (width * width * len(whole)))
        for at in range(0, max(len(rows) for _, _, rows in whole), step):
            now = [(first, cloud, rows[at : at + step]) for first, cloud, rows in whole if at < len(rows)]
            runs = [cloud[rows[0] - before : rows[-1] + after + 1] for _, cloud, rows in now]
            dist = [frame_distances(run, rows - rows[0], width) for run, (_, _, rows) in zip(runs, now)]
            places = np.concatenate([first + rows for first, _, rows in now])
            for i, found in zip(places, bars_of(np.concatenate(dist), max_edge)):
                bars[i] = found
        for (i, _), found in zip(parts, _by_shape([cloud for _, cloud in parts], max_edge)):
            bars[i] = found
        kept = table.take(pa.array(owned)).select([unique, "manifold", "block"]).combine_chunks()
        return kept.append_column("bars", _bars_array([bars[i] for i in owned]))

    n = compute_partitions(long.sparkSession)
    return long.repartition(n, "block").groupBy("block").applyInArrow(frames, schema)


def baseline_bars(
    wide: DataFrame,
    manifolds: list[str] = MANIFOLDS,
    n: int = BASELINE_SAMPLE,
    replicates: int = 1,
    normal: str = NORMAL,
    unique: str = "flow_id",
    seed: int = SEED,
    max_edge: float = MAX_EDGE,
) -> DataFrame:
    """(manifold, replicate, n_samples, dimension, n_features, bars) of a sample of normal rows.

    ``wide`` has a label and one array column per manifold. The sample size bounds each
    cloud; replicates and manifolds are separate tasks.
    """
    chosen = None
    for r in range(replicates):
        drawn = baseline_sample(wide, n, normal, unique, seed=seed + r)
        drawn = drawn.withColumn("replicate", F.lit(r))
        chosen = drawn if chosen is None else chosen.unionByName(drawn)
    chosen = long_points(chosen.select(unique, "replicate", *manifolds), manifolds)
    schema = T.StructType(
        [
            T.StructField("manifold", T.StringType()),
            T.StructField("replicate", T.IntegerType()),
            T.StructField("n_samples", T.LongType()),
            T.StructField("dimension", T.IntegerType()),
            T.StructField("n_features", T.IntegerType()),
            T.StructField("bars", BARS_TYPE),
        ]
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cloud = np.stack(rows.sort_values(unique)["vec"].to_numpy()).astype(float)
        found = barcodes(cloud[None], max_edge)[0]
        bars = [{"dim": int(d), "birth": b, "death": x} for d, b, x in found]
        return pd.DataFrame(
            [[*key, len(cloud), cloud.shape[1], len(bars), bars]], columns=schema.fieldNames()
        )

    tasks = compute_partitions(wide.sparkSession)
    return (
        chosen.repartition(tasks, "manifold", "replicate")
        .groupBy("manifold", "replicate")
        .applyInPandas(run, schema)
    )


def baseline_summary(baseline: DataFrame) -> DataFrame:
    """Bars per manifold and dimension of the baseline barcodes; 0 where a dimension has none."""
    counts = [
        F.struct(F.lit(d).alias("dim"), F.size(F.filter("bars", lambda b: b["dim"] == d)).cast("long").alias("n_bars"))
        for d in HOMOLOGY_DIMS
    ]
    return baseline.select("manifold", "replicate", "n_samples", "dimension", F.inline(F.array(*counts)))


def wide_points(points: DataFrame, manifolds: list[str], keep: list[str]) -> DataFrame:
    """Long points (keep.., manifold, vec) -> one array column per manifold."""
    columns = [
        F.first(F.when(F.col("manifold") == m, F.col("vec")), ignorenulls=True).alias(m)
        for m in manifolds
    ]
    return points.groupBy(*keep).agg(*columns)


def explode_bars(bars: DataFrame, keys: list[str], cap: float = MAX_EDGE) -> DataFrame:
    """(keys.., dim, birth, death), one row per bar, deaths capped."""
    out = bars.select(*keys, F.inline("bars"))
    return out.withColumn("death", cap_death(F.col("death"), cap))


def bars_by_dim(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Bars split by dimension: arrays h0 and h1 of (birth, death)."""
    return bars.select(
        *keys,
        *[
            F.transform(
                bars_of_dim(F.col("bars"), d), lambda b: F.struct(b["birth"].alias("birth"), b["death"].alias("death"))
            ).alias(f"h{d}")
            for d in (0, 1)
        ],
    )
