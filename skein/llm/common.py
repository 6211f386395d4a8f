"""Helpers that the operators of this package share."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import checkpoint_dir

#: Bytes of text that a task holds as numpy arrays at once.
SLICE_BYTES = 8 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_path(spark, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage, so that
    a lost executor costs a read and not the work that led to the table. Inside ``short_lived``
    only a table that ``stays`` outlives the block."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _MADE and not stays:
        _MADE[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Tables written inside each open ``short_lived`` block.
_MADE: list[list[tuple]] = []


@contextmanager
def short_lived() -> Iterator[None]:
    """Removes what the block wrote into the shared folder when it ends."""
    _MADE.append([])
    try:
        yield
    finally:
        for spark, path in _MADE.pop():
            _remove(spark, path)


def _remove(spark, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_shared(*tables: DataFrame) -> None:
    """Remove tables of ``shared_table`` that nothing reads any more."""
    for table in tables:
        for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            _remove(table.sparkSession, path)


def share(spark, value) -> Callable[[], object]:
    """Send a value to the executors once; tasks call the result. Objects of this package's classes
    travel by value, as its functions do, so that workers need no copy of the package."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def refuse_clashes(keep: list[str], added: list[str]) -> None:
    """Raise if a result column has the name of a kept one, in whatever spelling."""
    clash = {c.lower() for c in keep} & {c.lower() for c in added}
    if clash:
        raise ValueError(f"columns named {sorted(clash)} are in the table already; give a prefix")


def filter_places(keys: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """The place of each key among ``bits`` (a power of two) places."""
    return (mix64(keys.astype(np.uint64)) & (np.asarray(bits).astype(np.uint64) - np.uint64(1))).astype(np.int64)


def filter_block(keys: np.ndarray, most: int) -> bytes:
    """One bit set for each key, in at most ``most`` bytes and about two bytes a key."""
    size = 8
    while size < 2 * len(keys) and 2 * size <= most:
        size *= 2
    block = np.zeros(8 * size, bool)
    block[filter_places(keys, 8 * size)] = True
    return np.packbits(block, bitorder="little").tobytes()


class KeyFilter:
    """Which 64-bit keys may be among those that a filter was made of: one block of bits for each
    value of the keys' top bits, filled with the 32 bits below them."""

    def __init__(self, blocks: dict[int, bytes], top: int):
        every = [blocks.get(p, bytes(8)) for p in range(1 << top)]
        self.top, self.data = top, np.frombuffer(b"".join(every), np.uint8)
        self.size = np.array([len(b) for b in every], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def passes(self, keys: np.ndarray) -> np.ndarray:
        part, low = split_key(keys, self.top)
        place = filter_places(low, 8 * self.size[part])
        return (self.data[self.start[part] + (place >> 3)] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def split_key(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` bits of 64-bit keys, and the 32 bits below them."""
    low = (keys >> np.uint64(32 - top)) & np.uint64(0xFFFFFFFF)
    return (keys >> np.uint64(64 - top)).astype(np.int64), low.astype(np.uint32)


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` starts with it in any spelling."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def id_bucket(doc_id: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as empty text."""
    return F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")) % buckets


def byte_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs (start, length) of about ``limit`` bytes; a longer row stands alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i - start
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes) - start


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    make: Callable[[], Callable[[pa.Array], list]],
    fields: list[T.StructField],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """One output row per row: the columns ``keep`` and those computed from the whole text.

    ``make`` runs once in each task and returns the function from an Arrow string array
    without nulls (a null text counts as empty) to the arrays of ``fields``. A field with the name
    of a kept column raises an error.
    """
    refuse_clashes(keep, [f.name for f in fields])
    shown = text in keep  # then the text goes to the task once
    source = df.select(*[col(c) for c in keep], *([] if shown else [col(text).alias(free_name(df, "text_of_row"))]))
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    names, n_kept = schema.names, len(keep)
    at = keep.index(text) if shown else n_kept

    def run(batches):
        work = make()
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for start, n in byte_slices(sizes, limit):
                part = batch.slice(start, n)
                # concat_arrays copies the slice, so that offsets start at 0
                own = pa.concat_arrays([texts.slice(start, n)])
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *work(own)], names=names)

    return source.mapInArrow(run, schema)


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary array without nulls that starts at offset 0."""
    wide = values.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = values.buffers()
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    if data is None or ends[-1] == 0:
        return np.zeros(0, np.uint8), ends
    return np.frombuffer(data, np.uint8), ends


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: word numbers, number of words per text, and
    the distinct words that the numbers point to. ``lower`` lower-cases A-Z alone."""
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    coded = pa.concat_arrays([parts.flatten()]).dictionary_encode()
    words = coded.dictionary
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if blank.any():  # splitting leaves an empty word at either end of a text
        real = ~blank[ids]
        doc = np.repeat(np.arange(len(counts)), counts)[real]
        ids, counts = ids[real], np.bincount(doc, minlength=len(counts)).astype(np.int64)
    return ids, counts, words


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    small = total < 1 << 31 and (not len(starts) or int(starts.max()) + int(lengths.max()) < 1 << 31)
    kind = np.int32 if small else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """The runs of ``pool`` one after another; ``step`` runs at a time, to keep indices few."""
    out = np.empty(int(lengths.sum()), pool.dtype)
    at = 0
    for k in range(0, len(starts), step):
        part = pool[ragged(starts[k : k + step], lengths[k : k + step])]
        out[at : at + len(part)] = part
        at += len(part)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word that is the same in every task: a mixed sum over its bytes,
    each mixed with its place."""
    data, ends = flat_bytes(words)
    size = np.diff(ends)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        place = np.arange(int(ends[0]), int(ends[-1])) - np.repeat(ends[:-1], size)
        each = mix64(place.astype(np.uint64) * np.uint64(256) + data[ends[0] : ends[-1]] + np.uint64(1))
        out[full] = np.add.reduceat(each, ends[:-1][full] - ends[0])
    return mix64(out + size.astype(np.uint64))
