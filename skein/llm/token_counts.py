"""Exact token counts of a byte-level BPE vocabulary by compiled transducers.

Three machines, each run over all chunks of a slice of texts at once:

1. The splitter. Texts are cut into chunks before blanks that no pattern joins with what stands
   before them. Inside a chunk the class of a character and of its neighbours decides whether a
   pretoken starts (letters, numbers, other signs with one blank in front, contractions, runs of
   white space with the last one left for what follows).
2. The vocabulary machine. A trie over token bytes, walked from every byte of every distinct
   pretoken; it reports where tokens end.
3. The merge machine. Its state behind a byte is the last token of the prefix read so far, and
   the transition that enters the state carries the count of tokens emitted: one more than at
   the state where that token began. A token may follow the last token of a prefix only if
   undoing merges from the latest to the earliest never meets an earlier merge across the border
   of the two; just one token passes for every prefix, so the machine is deterministic.

A chunk's map takes the state at its start to the state behind it and a count. Chunks start
where every earlier state leads to the same one, so their maps compose by adding counts; the
text's total is read from a parallel prefix scan over the counts of its chunks.

Results equal the library's, special strings included. Null texts are empty and have no tokens.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.common import flat_bytes, map_texts
from skein.llm.units import Splitter

LIMIT = 512
SLICE_BYTES = 12 << 20


class Table:
    """Distinct 64-bit keys to numbers: open addressing, probed for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            _, firsts = np.unique(at[left[free]], return_index=True)
            put = left[free][firsts]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if there is none."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for
    themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeMachine:
    """The vocabulary trie and the merge tables of a byte-level BPE file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            held = json.load(file)
        letters, ids = byte_letters(), held["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        self.special = [t["content"] for t in held["added_tokens"]]
        # rank: bytes first, then merges in their order
        n = 256 + len(merges)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        rank = {letter: k for k, letter in enumerate(sorted(letters))}
        if any(letter not in ids for letter in letters):
            raise ValueError("the vocabulary lacks bytes")
        for k, (a, b) in enumerate(merges, 256):
            if a + b in rank:
                raise ValueError("a token is made by two merges")
            self.left[k], self.right[k] = rank[a], rank[b]
            rank[a + b] = k
        made = np.arange(256, n)
        self.pairs = Table(self.left[256:].astype(np.int64) * n + self.right[256:], made.astype(np.int32))
        self.n = n
        # trie: node 0 is the root; edges (node, byte) -> node
        edges: dict[int, int] = {}
        token_at = [-1]
        for token, number in rank.items():
            node = 0
            for letter in token:
                key = node * 256 + letters[letter]
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = number
        self.edges = Table(np.fromiter(edges, np.int64), np.fromiter(edges.values(), np.int32))
        self.token_at = np.array(token_at, np.int32)

    def may_follow(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the merges leave both tokens as they are when they stand side by side."""
        out = np.ones(len(last), bool)
        live = np.arange(len(last))
        u, v = last.astype(np.int64), token.astype(np.int64)
        limit = np.full(len(last), self.n, np.int64)
        while len(live):
            across = self.pairs.get(u * self.n + v)
            lost = (across >= 0) & (across < limit)
            out[live[lost]] = False
            go = ~lost & ((u >= 256) | (v >= 256))
            live, u, v, limit = live[go], u[go], v[go], limit[go]
            undo_left = (u > v) & (u >= 256) | (v < 256)
            # the later merge is undone first; of equal ones the right one, as merges go left to right
            limit = np.where(undo_left, u, v + 1)
            u, v = np.where(undo_left, self.right[u], u), np.where(undo_left, v, self.left[v])
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of every pretoken: bytes [starts[i], starts[i + 1]) of ``data``."""
        size = np.diff(starts)
        where = np.repeat(np.arange(len(size)), size)
        room = starts[1:][where] - np.arange(len(data))
        live, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        ends, begins, tokens = [], [], []
        length = 0
        while len(live):  # all places of all pretokens, one byte further each time
            node = self.edges.get(node * 256 + data[live + length])
            length += 1
            known = node >= 0
            live, node = live[known], node[known].astype(np.int64)
            token = self.token_at[node]
            hit = token >= 0
            begins.append(live[hit])
            ends.append(live[hit] + length)
            tokens.append(token[hit])
            more = room[live] > length
            live, node = live[more], node[more]
        begins, ends, tokens = map(np.concatenate, (begins, ends, tokens))
        inside = ends - starts[where[begins]]
        order = np.argsort(inside, kind="stable")
        begins, ends, tokens = begins[order], ends[order], tokens[order]
        cuts = np.searchsorted(inside[order], np.arange(1, int(size.max(initial=0)) + 2))
        last = np.full(len(data) + 1, -1, np.int32)  # state behind byte i, at i + 1
        emitted = np.zeros(len(data) + 1, np.int64)
        for lo, hi in zip(cuts, cuts[1:]):
            b, e, t = begins[lo:hi], ends[lo:hi], tokens[lo:hi]
            fresh = starts[where[b]] == b
            before = last[b]
            good = fresh.copy()
            old = np.flatnonzero(~fresh)
            good[old] = self.may_follow(before[old], t[old])
            base = np.where(fresh, 0, emitted[b])
            last[e[good]] = t[good]
            emitted[e[good]] = base[good] + 1
        return emitted[starts[1:]] * (size > 0)


class TokenCounter:
    """Counts of whole texts; made once in a task."""

    def __init__(self, vocabulary: str):
        self.machine = MergeMachine(vocabulary)
        self.splitter = Splitter(self.machine.special)

    def count(self, texts: pa.Array) -> np.ndarray:
        pieces, per = self.splitter.cut_special(texts)
        found = self.splitter.split(pieces)
        data, ends = flat_bytes(found.values)
        each = found.per_text(self.machine.counts(data[: ends[-1]], ends))
        ends = np.cumsum(per)
        scan = np.concatenate([[0], np.cumsum(each)])
        return scan[ends] - scan[ends - per] + per - 1


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    limit: int = LIMIT,
    prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` of every document (default: all) with n_bytes, n_tokens and
    over_limit (more than ``limit`` tokens), named with ``prefix``."""
    fields = [T.StructField(prefix + n, t) for n, t in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))]

    def make():
        counter = TokenCounter(vocabulary)

        def work(texts: pa.Array) -> list[pa.Array]:
            n = counter.count(texts)
            return [pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)]

        return work

    return map_texts(docs, text, docs.columns if keep is None else keep, make, fields, SLICE_BYTES)
