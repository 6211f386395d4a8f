"""Alignment of two tokenizers by the byte offsets where tokens of both end.

Each text is encoded by a byte-level vocabulary (A, with a space in front) and a piece vocabulary
(B, which adds that space). The running sums of token bytes are ends; a dictionary from end to
token for each side, and the keys that both have, in order, cut both id lists into groups. A token
has one byte at least, so the links of a group, its A-B pairs that end together, are the pair of
its last tokens. Long texts go through the dictionaries a million bytes at a time, which changes
nothing: an end meets its like in the same part.

The encoded rows are written once. Pairs are counted over all texts, and each row's links look up
those counts: pairs common enough for a table of at most ``HELD_PAIRS`` in the task, all others by a
join, in which no pair is hot.

Null and empty texts, and texts whose tokens do not spell the space and the text, have no tokens:
numbers are 0, the groups an empty text. Repeated rows each get their own result and count each
time; an empty table gives none. Ties for a B id's highest count all count as best. Columns of the
input come along as named in ``keep``; a result column among them raises an error, which ``prefix``
avoids.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import col, flat_bytes, free_name, gather, map_texts, shared_table
from skein.llm.units import IdEncoder

#: Pairs with their counts that a task holds, 17 bytes each.
HELD_PAIRS = 1 << 19
#: Bytes of text whose ends are in the dictionaries at once.
PART_BYTES = 1 << 20
SLICE_BYTES = 4 << 20


class TokenBytes:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.pool, self.start[ids], self.width[ids])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable,
    else the next letter from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteSide(TokenBytes):
    """Ids of a byte-level vocabulary; special strings in a text are plain text."""

    def __init__(self, vocabulary: str):
        self.encoder = IdEncoder(vocabulary)
        self.encoder.library.encode_special_tokens = True
        self.encoder.special = self.encoder.splitter.special = []
        letters = byte_letters()
        by_id = {k: token for token, k in self.encoder.library.get_vocab(False).items()}
        super().__init__([bytes(letters[c] for c in by_id.get(k, "")) for k in range(max(by_id) + 1)])

    def encode(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.encoder.encode(spaced)
        return ids.astype(np.int64), counts


class PieceSide(TokenBytes):
    """Ids of a piece vocabulary, each distinct unit encoded once. A unit is a run of spaces and
    what follows; no piece has a space behind another character, so no merge crosses units."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of this model joins words")
        self.space = self.library.piece_to_id("▁")
        super().__init__(
            [
                bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace("▁", " ").encode()
                for k, p in enumerate(pieces)
            ]
        )

    def encode(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, ends = flat_bytes(spaced)
        data = data[: ends[-1]]
        space = data == 0x20
        head = np.zeros(len(data), bool)
        head[ends[:-1]] = True  # every text starts with its space
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        starts = np.flatnonzero(begin | head)
        offsets = np.append(starts, len(data)).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data.tobytes())).dictionary_encode()
        number = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        units = [u[1:] for u in found.dictionary.to_pylist()]
        each = [e if u else [self.space] for u, e in zip(units, self.library.encode(units, num_threads=1))] if units else []
        size = np.array([len(e) for e in each], np.int64)
        pool = np.fromiter(chain.from_iterable(each), np.int64, int(size.sum()))
        ids = gather(pool, (np.cumsum(size) - size)[number], size[number])
        doc = np.searchsorted(ends, starts, side="right") - 1
        return ids, np.bincount(doc, size[number], minlength=len(spaced)).astype(np.int64)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, part_bytes: int = PART_BYTES) -> tuple[list[int], list[int]]:
    """Indices of the A and B tokens that end together, in order."""
    at_a, at_b = [], []
    last = int(max(ends_a[-1], ends_b[-1])) if len(ends_a) and len(ends_b) else 0
    for start in range(0, last, part_bytes):
        sides = []
        for ends in (ends_a, ends_b):
            i, j = np.searchsorted(ends, [start, start + part_bytes], side="right").tolist()
            sides.append(dict(zip(ends[i:j].tolist(), range(i, j))))
        a, b = sides
        common = sorted(a.keys() & b.keys())
        at_a.extend(map(a.__getitem__, common))
        at_b.extend(map(b.__getitem__, common))
    return at_a, at_b


class GroupText:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``: each id's digits with the sign behind it come from a
    pool of bytes."""

    SIGNS = (",", "|", ",", ";")

    def __init__(self, n_a: int, n_b: int):
        texts = [f"{k}{sign}" for sign, n in zip(self.SIGNS, (n_a, n_a, n_b, n_b)) for k in range(n)]
        self.first = np.array([0, n_a, 2 * n_a, 2 * n_a + n_b], np.int64)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer("".join(texts).encode(), np.uint8)

    def write(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, texts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The groups of many texts one after another, cut behind the tokens ``at_a`` and ``at_b``, and
        where each text ends; ``texts`` has the number of groups of each."""
        width_a, width_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        code = np.empty(len(a) + len(b), np.int64)
        # a token stands behind all of its own side before it and the other side's earlier groups
        code[np.arange(len(a)) + np.repeat(np.cumsum(width_b) - width_b, width_a)] = a + self._signs(0, at_a, len(a))
        code[np.arange(len(b)) + np.repeat(np.cumsum(width_a), width_b)] = b + self._signs(2, at_b, len(b))
        written = gather(self.pool, self.start[code], self.size[code])
        tokens = np.concatenate([[0], np.cumsum(width_a + width_b)])[np.concatenate([[0], np.cumsum(texts)])]
        ends = np.concatenate([[0], np.cumsum(self.size[code])])[tokens]
        return written.tobytes(), ends

    def _signs(self, side: int, last: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.first[side], np.int64)
        out[last] = self.first[side + 1]
        return out


def _spelled(side: TokenBytes, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text's tokens spell its bytes."""
    doc = np.repeat(np.arange(len(counts)), counts)
    size = np.diff(ends)
    good = np.bincount(doc, side.width[ids], minlength=len(counts)) == size
    differ = side.spell(ids[good[doc]]) != data[np.repeat(good, size)]
    if differ.any():
        owner = np.repeat(np.flatnonzero(good), size[good])
        good[np.unique(owner[differ])] = False
    return good


class Aligner:
    """Made once in a task."""

    def __init__(self, vocabulary: str, model: str, groups: bool):
        self.a, self.b, self.groups = ByteSide(vocabulary), PieceSide(model), groups
        self.text = GroupText(len(self.a.width), len(self.b.width))

    def work(self, texts: pa.Array) -> list[pa.Array]:
        spaced = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type))
        data, ends = flat_bytes(spaced)
        data = data[: ends[-1]]
        sides, good = [], np.diff(ends) > 1
        for side in (self.a, self.b):
            ids, counts = side.encode(spaced)
            good &= _spelled(side, ids, counts, data, ends)
            sides.append((ids, counts))
        # from here on, only texts with tokens
        (a, n_a), (b, n_b) = ((ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in sides)
        cut_a, cut_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        width_a, width_b = self.a.width[a], self.b.width[b]
        at_a, at_b, n_groups = [], [], np.zeros(len(texts), np.int64)
        for k in np.flatnonzero(good):
            mine = slice(cut_a[k], cut_a[k + 1]), slice(cut_b[k], cut_b[k + 1])
            last_a, last_b = common_ends(np.cumsum(width_a[mine[0]]), np.cumsum(width_b[mine[1]]))
            at_a.append(np.array(last_a, np.int64) + cut_a[k])
            at_b.append(np.array(last_b, np.int64) + cut_b[k])
            n_groups[k] = len(last_a)
        last_a, last_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at_a, at_b))
        written, stops = self.text.write(a, b, last_a, last_b, n_groups)
        # without the last semicolon
        lines = [written[i : j - 1] if j > i else b"" for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]
        digests = [hashlib.sha256(line).hexdigest() if line else "" for line in lines]
        links = (a[last_a] << 32) | b[last_b]
        pairs, times, per, cuts = [], [], [], np.concatenate([[0], np.cumsum(n_groups)])
        for i, j in zip(cuts[:-1], cuts[1:]):
            pair, n = np.unique(links[i:j], return_counts=True)
            pairs.append(pair)
            times.append(n)
            per.append(len(pair))
        columns = [pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_groups)]  # one link a group
        columns.append(pa.array(digests, pa.string()))
        if self.groups:
            columns.append(pa.array([line.decode() for line in lines], pa.string()))
        each = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(pairs) if pairs else [], pa.int64()), pa.array(np.concatenate(times) if times else [], pa.int64())],
            names=["pair", "n"],
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        return [*columns, pa.ListArray.from_arrays(offsets, each)]


_PAIRS = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())]))


def count_pairs(links: DataFrame) -> DataFrame:
    """pair (A id times 2**32 and B id), count, and whether it is the highest of its B id."""
    counts = links.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = shared_table(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    # one row for each id of B at most
    best = counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return shared_table(best, "pair-best")


def _held(counts: DataFrame, most: int) -> tuple[np.ndarray, ...]:
    """The commonest pairs, at most ``most``: all those whose counts have so many bits or more."""
    bits = F.length(F.bin("count"))
    sizes = {r[0]: r[1] for r in counts.groupBy(bits).count().collect()}  # one row for each number of bits
    least, total = 65, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    found = counts.where(bits >= least).select("pair", "count", "best").toArrow()
    pair, count, best = (found.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    return pair[order], count[order], best[order].astype(bool)


def _look_up(rows: DataFrame, counts: DataFrame, row: str, most: int) -> DataFrame:
    """For each row, the sum of its links' counts and the number of best links."""
    shared = rows.sparkSession.sparkContext.broadcast(_held(counts, most))

    def look(batches):
        pair, count, best = shared.value
        for batch in batches:
            lists = batch.column(1)
            each = lists.flatten()
            mine, n = (each.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), size)
            at = np.searchsorted(pair, mine)
            known = at < len(pair)
            known[known] = pair[at[known]] == mine[known]
            sums = np.zeros((2, len(lists)), np.int64)
            np.add.at(sums[0], owner[known], n[known] * count[at[known]])
            np.add.at(sums[1], owner[known], n[known] * best[at[known]])
            rest = np.bincount(owner[~known], minlength=len(lists))
            left = pa.StructArray.from_arrays([pa.array(mine[~known]), pa.array(n[~known])], names=["pair", "n"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(rest)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(offsets, left)],
                names=["row", "count_sum", "n_best", "rest"],
            )

    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("n_best", T.LongType())]
        + [T.StructField("rest", _PAIRS)]
    )
    found = shared_table(rows.select(col(row), "links").mapInArrow(look, schema), "pair-looked-up")
    rest = found.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(counts, "pair")
    rest = rest.select(
        "row", (F.col("n") * F.col("count")).alias("count_sum"), F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best")
    )
    both = found.drop("rest").unionByName(rest)
    return both.groupBy(F.col("row").alias(row)).agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def align_tokens(
    docs: DataFrame,
    vocabulary: str,
    model: str,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    prefix: str = "",
    groups: bool = False,
    held_pairs: int = HELD_PAIRS,
) -> DataFrame:
    """The columns ``keep`` of every row (default: all) and, named with ``prefix``: n_a, n_b (tokens
    of each side), n_groups, n_links, n_best (links whose count is their B id's highest), count_sum
    (of all links), groups_sha256 and, if ``groups``, the groups as text ``a1,a2|b1;a3|b2,b3``."""
    keep = docs.columns if keep is None else keep
    shown = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"] + (["groups"] if groups else [])
    results = [prefix + n for n in (*shown[:4], "n_best", "count_sum", *shown[4:])]
    clash = {c.lower() for c in keep} & {c.lower() for c in results}
    if clash:
        raise ValueError(f"columns named {sorted(clash)} are in the table already; give a prefix")
    # while the work goes on, kept columns have names of their own
    held = docs.select(*[col(c).alias(f"kept_{k}") for k, c in enumerate(keep)], col(text).alias("whole"))
    fields = [T.StructField(n, T.StringType() if n.startswith("groups") else T.LongType()) for n in shown]
    own = [c for c in held.columns if c != "whole"]
    made = map_texts(
        held, "whole", own, lambda: Aligner(vocabulary, model, groups).work, [*fields, T.StructField("links", _PAIRS)], SLICE_BYTES
    )
    row = free_name(made, "row_number")
    rows = shared_table(made.withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = count_pairs(rows.select(F.explode("links").alias("x")).select("x.*"))
    sums = _look_up(rows, counts, row, held_pairs)
    joined = rows.drop("links").join(sums, row)
    names = [(f"kept_{k}", c) for k, c in enumerate(keep)] + [(n.removeprefix(prefix), n) for n in results]
    return joined.select(*[F.col(a).alias(b) for a, b in names])
