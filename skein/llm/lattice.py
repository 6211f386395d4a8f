"""Marginal log probability of texts over all segmentations into subwords.

The pieces are those of an existing byte-level vocabulary; every byte is a piece, so every text
has a probability. A text is read as its lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``, each
with one blank before it, and an end. Pieces that hold a blank elsewhere than in front are left
out; so every segmentation of a text parts at its words, and the forward recursion over the text
(log space: the state at a byte is the log sum over all pieces that end there) adds up the
recursions of its words.

Piece scores start from the order of the vocabulary (a piece's share falls with its rank) and
follow the training documents: ``rounds`` times, expected piece counts over all segmentations of
all training words, forward and backward, plus the former scores with the weight of ``prior``
pieces, become the new ones. The end is one more piece; its count is that of training documents.
All scores sum to one.

Work is done once per distinct word of the whole corpus. Documents are reduced in their tasks to
(word, documents holding it) per batch, these rows are joined with the counted words, and each
task sums per document before the last shuffle. Frequent words have one row per batch; the join
is an ordinary one, whose large partitions Spark splits. Words are exact, never hashed.

A null text is empty and has its end alone. Repeated rows are each scored; rows are told apart
by their place in their batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import byte_slices, col, flat_bytes, shared_table, split_words
from skein.llm.token_counts import MergeMachine, byte_letters

BATCH_BYTES = 24 << 20


@dataclass(frozen=True)
class LatticeSettings:
    rounds: int = 2
    prior: float = 1000.0
    rank_offset: float = 50.0


class Lattice:
    """The piece trie with scores; made once in a task."""

    def __init__(self, vocabulary: str):
        self.machine = MergeMachine(vocabulary)
        self.edges, self.token_at = self.machine.edges, self.machine.token_at.copy()
        self.usable = usable_pieces(self.machine)
        self.token_at[~np.isin(self.token_at, np.flatnonzero(self.usable))] = -1

    def arcs(self, rows: np.ndarray):
        """Arcs of equally long byte strings: for each start and length the rows and pieces."""
        n, size = rows.shape
        found = [[] for _ in range(size + 1)]  # by end
        for start in range(size):
            live, node = np.arange(n), np.zeros(n, np.int64)
            for end in range(start + 1, size + 1):
                node = self.edges.get(node * 256 + rows[live, end - 1])
                known = node >= 0
                live, node = live[known], node[known].astype(np.int64)
                if not len(live):
                    break
                piece = self.token_at[node]
                hit = piece >= 0
                if hit.any():
                    found[end].append((start, live[hit], piece[hit]))
        return found

    def forward(self, rows: np.ndarray, scores: np.ndarray, arcs=None) -> np.ndarray:
        """Log marginal of every prefix: (rows, size + 1)."""
        n, size = rows.shape
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0.0
        for end, ending in enumerate(arcs or self.arcs(rows)):
            for start, live, piece in ending:
                alpha[live, end] = np.logaddexp(alpha[live, end], alpha[live, start] + scores[piece])
        return alpha

    def expect(self, rows: np.ndarray, weight: np.ndarray, scores: np.ndarray, into: np.ndarray) -> None:
        """Add the expected piece counts of weighted words."""
        arcs = self.arcs(rows)
        alpha = self.forward(rows, scores, arcs)
        n, size = rows.shape
        beta = np.full((n, size + 1), -np.inf)
        beta[:, size] = 0.0
        for end in range(size, 0, -1):
            for start, live, piece in arcs[end]:
                through = scores[piece] + beta[live, end]
                share = np.exp(alpha[live, start] + through - alpha[live, size]) * weight[live]
                into += np.bincount(piece, share, minlength=len(into))
                beta[live, start] = np.logaddexp(beta[live, start], through)


def usable_pieces(machine: MergeMachine) -> np.ndarray:
    """Pieces without a blank, or with one in front alone."""
    blank = np.zeros(machine.n, np.int8)  # 0: none, 1: in front, 2: elsewhere
    letters = byte_letters()
    for number, letter in enumerate(sorted(letters)):
        blank[number] = letters[letter] == 0x20
    for k in range(256, machine.n):
        left, right = blank[machine.left[k]], blank[machine.right[k]]
        blank[k] = 2 if right or left == 2 else left
    return blank < 2


def by_length(words: pa.Array, most: int = 20_000):
    """Words with a blank in front as equally long rows of bytes: (numbers, rows)."""
    data, ends = flat_bytes(words)
    size = np.diff(ends)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        length = int(size[order[lo]])
        step = max(1, min(most, (4 << 20) // (length + 1)))
        for at in range(lo, hi, step):
            part = order[at : min(at + step, hi)]
            rows = np.full((len(part), length + 1), 0x20, np.uint8)
            rows[:, 1:] = data[ends[part][:, None] + np.arange(length)]
            yield part, rows


_ROWS = [
    T.StructField("batch", T.LongType()),
    T.StructField("word", T.StringType()),
    T.StructField("train", T.LongType()),
    T.StructField("docs", T.BinaryType()),
    T.StructField("place", T.IntegerType()),
]


def word_rows(docs: DataFrame, text: str, train: Column, keep: list[str]) -> DataFrame:
    """Per batch of documents one row per distinct word: how often it occurs in training
    documents, and which documents hold it how often (place in the batch and count, 4 bytes
    each). The end of a text is the empty word. One more row per document has no word, but its
    place and the columns ``keep``, as kept_0, kept_1 and so on."""
    source = docs.select(
        F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce(col(text), F.lit("")).alias("text"),
        *[col(c).alias(f"kept_{k}") for k, c in enumerate(keep)],
    )
    schema = T.StructType(_ROWS + source.schema.fields[2:])

    def reduce(batches):
        batch_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for start, n in byte_slices(sizes, BATCH_BYTES):
                part = batch.slice(start, n)
                words = _batch_rows(part, batch_id)
                nothing = [pa.nulls(words.num_rows, c.type) for c in part.columns[2:]]
                empty = [pa.nulls(n, t) for t in (pa.string(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*words.columns, *nothing], names=schema.names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch_id)), *empty, pa.array(np.arange(n, dtype=np.int32)), *part.columns[2:]],
                    names=schema.names,
                )
                batch_id += 1

    return source.mapInArrow(reduce, schema)


def _batch_rows(batch: pa.RecordBatch, batch_id: int) -> pa.RecordBatch:
    numbers, counts, words = split_words(pa.concat_arrays([batch.column(1)]), lower=True)
    n_docs, trained = len(counts), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
    keys = numbers * n_docs + np.repeat(np.arange(n_docs), counts)
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(np.append(first, len(keys)))
    # the end of every text comes last
    word = np.concatenate([keys[first] // n_docs, np.full(n_docs, len(words))])
    doc = np.concatenate([keys[first] % n_docs, np.arange(n_docs)])
    times = np.concatenate([times, np.ones(n_docs, np.int64)])
    total = np.bincount(word, times * trained[doc], minlength=len(words) + 1).astype(np.int64)
    pairs = np.stack([doc, times], 1).astype("<u4").tobytes()
    ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words) + 1))]) * 8
    blobs = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(words) + 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pairs)]
    )
    names = pa.concat_arrays([words.cast(pa.string()), pa.array([""], pa.string())])
    n = len(names)
    found = pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, batch_id)), names, pa.array(total), blobs.cast(pa.binary()), pa.nulls(n, pa.int32())],
        names=[f.name for f in _ROWS],
    )
    return found.filter(pa.array(np.diff(ends) > 0))  # a blank word at a text's border is none


def fit_scores(words: DataFrame, vocabulary: str, ends: int, settings: LatticeSettings) -> np.ndarray:
    """Log scores of all pieces, the end last. ``words``: distinct words with their count."""
    machine = MergeMachine(vocabulary)
    usable = usable_pieces(machine)
    share = np.where(usable, 1 / (np.arange(machine.n) + settings.rank_offset), 0.0)
    share /= share.sum()
    total = None
    schema = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("n", T.DoubleType())])
    trained = words.where("train > 0 and word != ''").select("word", "train")
    for _ in range(settings.rounds):
        with np.errstate(divide="ignore"):
            shared = words.sparkSession.sparkContext.broadcast(np.log(share))

        def expect(batches):
            lattice, into = None, None
            for batch in batches:
                if lattice is None:
                    lattice, scores = Lattice(vocabulary), shared.value
                    into = np.zeros(len(scores))
                weight = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                for part, rows in by_length(pa.concat_arrays([batch.column(0)])):
                    lattice.expect(rows, weight[part], scores, into)
            if into is not None:
                at = np.flatnonzero(into)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(into[at])], names=schema.names)

        # at most one row per piece comes back
        rows = trained.mapInArrow(expect, schema).groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = settings.prior * share
        counts[rows["piece"].to_numpy()] += rows["n"].to_numpy()
        total = counts.sum()
        share = counts / total
    ended = ends + 1.0
    total = settings.prior if total is None else total
    whole = total + ended
    with np.errstate(divide="ignore"):
        return np.append(np.log(share * total / whole), np.log(ended / whole))


_SUMS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("sums", T.BinaryType())])
_RESULT = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
]
#: Documents whose sums a task holds at once.
_OPEN_DOCUMENTS = 1 << 20


def _sum_task(batches):
    """Rows (batch, docs, train, base, score) of words: sums per document, packed per batch."""
    held: dict[int, np.ndarray] = {}

    def flush():
        for batch, sums in held.items():
            at = np.flatnonzero(sums[:, 0])
            packed = np.concatenate([at[:, None], sums[at]], 1).astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([packed], pa.binary())], names=_SUMS.names)
        held.clear()

    for rows in batches:
        owner = rows.column(0).to_numpy(zero_copy_only=False)
        data, ends = flat_bytes(pa.concat_arrays([rows.column(1)]))
        pairs = np.frombuffer(data[: ends[-1]].tobytes(), "<u4").reshape(-1, 2).astype(np.int64)
        row = np.repeat(np.arange(len(owner)), np.diff(ends) // 8)
        value = [rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
        for batch in np.unique(owner):
            mine = owner[row] == batch
            doc, times, at = pairs[mine, 0], pairs[mine, 1], row[mine]
            size = int(doc.max()) + 1
            sums = held.get(batch, np.zeros((0, 4)))
            if len(sums) < size:
                sums = np.concatenate([sums, np.zeros((size - len(sums), 4))])
            for k, x in enumerate((times, times * (value[0][at] > 0), times * value[1][at], times * value[2][at])):
                sums[:size, k] += np.bincount(doc, x, minlength=size)
            held[batch] = sums
        if sum(map(len, held.values())) > _OPEN_DOCUMENTS:
            yield from flush()
    yield from flush()


def score_texts(
    docs: DataFrame,
    vocabulary: str,
    train: Column,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    settings: LatticeSettings = LatticeSettings(),
) -> DataFrame:
    """The columns ``keep`` of every document (default: all), n_tokens, n_known, train_tokens,
    base_score (word model with 0.1 added to counts) and score (log10 of the marginal); a kept
    column with such a name raises an error. ``train``: which documents to learn from."""
    keep = docs.columns if keep is None else keep
    clash = {c.lower() for c in keep} & {f.name for f in _RESULT}
    if clash:
        raise ValueError(f"kept columns are named like results: {sorted(clash)}")
    spark = docs.sparkSession
    rows = shared_table(word_rows(docs, text, train, keep), "lattice-rows")
    listed = rows.where(F.col("word").isNotNull())
    words = shared_table(listed.groupBy("word").agg(F.sum("train").alias("train")), "lattice-words")
    known = words.agg(
        F.sum("train").alias("n"),
        F.count(F.when(F.col("train") > 0, 1)).alias("v"),
        F.max(F.when(F.col("word") == "", F.col("train"))).alias("ends"),
    ).first()
    n, v, ends = known["n"] or 0, known["v"] or 0, known["ends"] or 0
    shared = spark.sparkContext.broadcast(fit_scores(words, vocabulary, ends, settings))
    schema = T.StructType([*words.schema.fields, T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])
    floor = 0.1

    def value(batches):
        lattice = Lattice(vocabulary)
        scores = shared.value
        for batch in batches:
            count = batch.column(1).to_numpy(zero_copy_only=False)
            base = np.log10((count + floor) / (n + floor * (v + 1)))
            score = np.empty(len(count))
            for part, strings in by_length(pa.concat_arrays([batch.column(0)])):
                if strings.shape[1] == 1:  # the empty word is the end
                    score[part] = scores[-1]
                else:
                    score[part] = lattice.forward(strings, scores)[:, -1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base), pa.array(score / np.log(10))], names=schema.names
            )

    joined = listed.select("word", "batch", "docs").join(words.mapInArrow(value, schema), "word")
    packed = joined.select("batch", "docs", "train", "base", "score").mapInArrow(_sum_task, _SUMS)
    result = T.StructType([T.StructField("batch", T.LongType()), T.StructField("place", T.IntegerType()), *_RESULT])

    def unite(table: pa.Table) -> pa.Table:
        parts = np.concatenate([np.frombuffer(x, "<f8").reshape(-1, 5) for x in table["sums"].to_pylist()])
        place = parts[:, 0].astype(np.int64)
        sums = [np.bincount(place, parts[:, k]) for k in range(1, 5)]
        m = len(sums[0])
        return pa.Table.from_arrays(
            [
                pa.array(np.full(m, table["batch"][0].as_py())),
                pa.array(np.arange(m, dtype=np.int32)),
                pa.array(np.rint(sums[0]).astype(np.int64)),
                pa.array(np.rint(sums[1]).astype(np.int64)),
                pa.array(np.full(m, n, np.int64)),
                pa.array(sums[2]),
                pa.array(sums[3]),
            ],
            names=result.names,
        )

    scored = packed.groupBy("batch").applyInArrow(unite, result)
    owners = rows.where(F.col("word").isNull()).drop("word", "train", "docs")
    return owners.join(scored, ["batch", "place"]).select(
        *[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], *[f.name for f in _RESULT]
    )
