"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``size`` consecutive words (a shorter item is one
window). A window's shingles are its adjacent word pairs (its one word, if it has only one).
Shingles are ordered by rarity, counted over all documents. A window can only occur where its
rarest shingle occurs, so that shingle is the necessary prefix of the window: documents are
joined with windows on it. The place of the shingle inside the window fixes where the window
would have to start and end; starts before the first word or ends behind the last are dropped,
and what is left is compared word by word.

The benchmark is held in slices of at most ``slice_bytes`` bytes of text, which bounds what a
task holds. One slice is one pass over the documents; with more slices every slice makes its
own pass and the spans found are merged per distinct text.

Null texts have no words; a null item id counts as the empty id; an item without words has no
window; repeated ids count once. Documents keep their rows, repeated ones included.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import col, free_name, map_texts

WINDOW = 10
SLICE_BYTES = 16 << 20

#: A-Z to lower case; everything outside 0-9, a-z and non-ASCII to a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

Words = tuple[bytes, ...]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], size: int) -> list[Words]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def shingles_of(window: Words) -> list[tuple]:
    """Adjacent pairs; a window of one word has that word."""
    return list(zip(window, window[1:])) if len(window) > 1 else [window]


def _places(words: list[bytes], wanted, single: bool) -> list[tuple[int, tuple]]:
    found = [(i, p) for i, p in enumerate(zip(words, words[1:])) if p in wanted]
    if single:
        found += [(i, (w,)) for i, w in enumerate(words) if (w,) in wanted]
    return found


def _slices(benchmark: DataFrame, item: str, text: str, limit: int) -> list[list[tuple[str, bytes]]]:
    """Read the benchmark slice by slice, each of about ``limit`` bytes."""
    rows = benchmark.select(
        F.coalesce(col(item).cast("string"), F.lit("")).alias("item"),
        F.coalesce(col(text), F.lit("")).cast("binary").alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit) or 1
    parts = (rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else rows for k in range(n))
    return ([(r["item"], bytes(r["text"])) for r in part.collect()] for part in parts)


def shingle_counts(docs: DataFrame, text: str, shingles: set) -> dict[tuple, int]:
    """How often each benchmark shingle occurs in all documents."""
    single = any(len(s) == 1 for s in shingles)
    shared = docs.sparkSession.sparkContext.broadcast(shingles)
    schema = T.StructType(
        [T.StructField("first", T.BinaryType()), T.StructField("second", T.BinaryType()), T.StructField("n", T.LongType())]
    )
    source = docs.select(col(text)).where(col(text).isNotNull())

    def count(batches):
        wanted, seen = shared.value, Counter()
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(p for _, p in _places(words_of(value), wanted, single))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.binary()),
                pa.array([k[1] if len(k) > 1 else None for k in keys], pa.binary()),
                pa.array([seen[k] for k in keys], pa.int64()),
            ],
            names=["first", "second", "n"],
        )

    rows = source.mapInArrow(count, schema).groupBy("first", "second").agg(F.sum("n").alias("n")).collect()
    return {
        (bytes(r["first"]),) if r["second"] is None else (bytes(r["first"]), bytes(r["second"])): r["n"] for r in rows
    }


def prefix_index(items: list[tuple[str, bytes]], size: int, counts) -> dict:
    """shingle -> {(offset in the window, words of the window) -> {window -> item ids}}."""
    index: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for item, value in items:
        for window in windows_of(words_of(value), size):
            shingles = shingles_of(window)
            at = min(range(len(shingles)), key=lambda i: (counts.get(shingles[i], 0), shingles[i], i))
            index[shingles[at]][at, len(window)][window].add(item)
    return {s: {k: {w: sorted(i) for w, i in v.items()} for k, v in places.items()} for s, places in index.items()}


def spans_in(words: list[bytes], index: dict, single: bool) -> tuple[list[int], set[str]]:
    """Merged [start, end) spans of the windows that occur, flattened, and their items."""
    found, items = [], set()
    for i, shingle in _places(words, index, single):
        for (offset, length), windows in index[shingle].items():
            start = i - offset
            if start < 0 or start + length > len(words):
                continue
            owners = windows.get(tuple(words[start : start + length]))
            if owners:
                found.append((start, start + length))
                items.update(owners)
    return merge_spans(found), items


def merge_spans(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _columns(rows: list[tuple[int, list[int], list[str]]]) -> list[pa.Array]:
    hits = [sum(s[1::2]) - sum(s[::2]) for _, s, _ in rows]
    return [
        pa.array([n for n, _, _ in rows], pa.int64()),
        pa.array(hits, pa.int64()),
        pa.array([len(i) for _, _, i in rows], pa.int64()),
        pa.array([_digest(i) for _, _, i in rows], pa.string()),
        pa.array([h > 0 for h in hits], pa.bool_()),
        pa.array([s for _, s, _ in rows], pa.list_(pa.int32())),
        pa.array([i for _, _, i in rows], pa.list_(pa.string())),
    ]


def _pass(docs: DataFrame, text: str, keep: list[str], index: dict, prefix: str) -> DataFrame:
    single = any(len(s) == 1 for s in index)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        held = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for value in texts.cast(pa.binary()).to_pylist():
                words = words_of(value)
                spans, items = spans_in(words, held, single)
                rows.append((len(words), spans, sorted(items)))
            return _columns(rows)

        return work

    fields = [T.StructField(prefix + f.name, f.dataType) for f in _FOUND]
    return map_texts(docs, text, keep, make, fields)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
    prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` of every document (default: all) with n_words, n_hit, n_items,
    items_sha256, contaminated, spans and items, each named with ``prefix``."""
    keep = docs.columns if keep is None else keep
    passes = []
    for items in _slices(benchmark, item, item_text, slice_bytes):
        wanted = {s for _, value in items for w in windows_of(words_of(value), size) for s in shingles_of(w)}
        counts = shingle_counts(docs, text, wanted) if wanted else {}
        passes.append(prefix_index(items, size, counts))
    if len(passes) == 1:
        return _pass(docs, text, keep, passes[0], prefix)
    return _merged(docs, text, keep, passes, prefix)


def _merged(docs: DataFrame, text: str, keep: list[str], passes: list[dict], prefix: str) -> DataFrame:
    """More than one slice: spans are united per distinct text, then joined back to its rows."""
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(col(text), F.lit("")).cast("binary"), 256))
    texts = keyed.groupBy(key).agg(F.first(F.coalesce(col(text), F.lit(""))).alias("text"))
    found = None
    for index in passes:
        one = _pass(texts, "text", [key], index, "").select(key, "n_words", "spans", "items")
        found = one if found is None else found.unionByName(one)
    united = found.groupBy(key).agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    fields = [T.StructField(prefix + f.name, f.dataType) for f in _FOUND]
    schema = T.StructType([united.schema[key], *fields])

    def merge(batches):
        for batch in batches:
            rows = [
                (n, merge_spans(list(zip(s[::2], s[1::2]))), sorted(i))
                for n, s, i in zip(*(batch.column(c).to_pylist() for c in ("n_words", "spans", "items")))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(key), *_columns(rows)], names=schema.names)

    joined = keyed.join(united.mapInArrow(merge, schema), key)
    return joined.select(*[col(c) for c in keep], *[col(f.name) for f in fields])
