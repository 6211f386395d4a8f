"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. Rolling hashes of several n-gram lengths run
over the word numbers of a slice of texts at once; equal hashes inside one text mark every word
of those n-grams, the first occurrence included, and the marked words' characters over all word
characters are the coverage of that length. Lines are repeated if an equal line with a word
stands earlier in the text. Word numbers are exact inside a slice, and hashes are compared only
inside one text, with 64 bits.

A text is kept if no base rule fails (fewer than ``min_words`` words, or more than half of the
words in 3-word windows found twice) and no coverage exceeds its limit. Null and empty texts
have no words, so they fail.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skein.llm.common import flat_bytes, map_texts, mix64, split_words

SYMBOLS = b"#*$%&|<>"
BASE_N = 3


@dataclass(frozen=True)
class RepetitionRules:
    """Limits: shares of a text's characters; coverage counts every occurrence. They lie below the
    base rule and fall with n, as words in longer repeated n-grams lie in repeated 3-word windows
    too. They were set above what good documents with crc32(doc_id) % 2 = 0 reach at sf0.1 (0.23
    for 4, 6 and 8 words and for lines, 0.17 for 10); the other half was in view too."""

    min_words: int = 50
    base_percent: int = 50
    coverage: tuple[tuple[int, float], ...] = ((4, 0.40), (6, 0.36), (8, 0.32), (10, 0.28))
    lines: float = 0.32
    symbols_per_word: float = 0.25

    def columns(self) -> list[str]:
        return [f"cover_{n}" for n, _ in self.coverage] + ["cover_lines"]


def coverage_starts(ids: np.ndarray, doc: np.ndarray, lengths: list[int]):
    """For each n-gram length in ascending order: the length, and whether the n-gram that starts
    at a word occurs twice or more in its text."""
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    value, of_doc = mix64(ids + 1), mix64(doc + 0x5851F42D)
    rolling, n_words = value.copy(), len(ids)
    n = 1
    for length in lengths:
        while n < length:  # one more word for every n-gram that still fits into the array
            rolling = rolling[:-1] * multiplier + value[n:] if len(rolling) > 1 else rolling[:0]
            n += 1
        starts = np.zeros(n_words, bool)
        if len(rolling):
            inside = np.flatnonzero(doc[: len(rolling)] == doc[n - 1 :])
            key = mix64(rolling[inside]) ^ of_doc[inside]
            order = np.argsort(key)
            key = key[order]
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            same[:-1] |= same[1:]
            starts[inside[order[same]]] = True
        yield length, starts


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Words inside an n-gram that starts at a marked word."""
    change = np.zeros(len(starts) + n, np.int32)
    change[: len(starts)] += starts
    change[n:] -= starts
    return np.cumsum(change)[: len(starts)] > 0


def line_repeats(text: str) -> tuple[int, int]:
    """Lines equal to an earlier line with a word; characters in lines found twice or more."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0, 0
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    again = [(line, k) for line, k in seen.items() if k > 1 and line.strip(" \t\n\r\x0b\x0c")]
    return sum(k - 1 for _, k in again), sum(k * sum(map(len, line.split())) for line, k in again)


def _measure(rules: RepetitionRules):
    symbol = np.zeros(256, np.uint8)
    symbol[list(SYMBOLS)] = 1
    lengths = sorted({BASE_N, *(n for n, _ in rules.coverage)})
    limits = dict(rules.coverage)

    def work(texts: pa.Array) -> list[pa.Array]:
        n_docs = len(texts)
        ids, counts, words = split_words(texts)
        doc = np.repeat(np.arange(n_docs), counts)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[ids]

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(doc, values, minlength=n_docs)

        chars = total(size).astype(np.int64)
        data, ends = flat_bytes(texts)
        marks = np.concatenate([[0], np.cumsum(symbol[data[: ends[-1]]], dtype=np.int64)])
        symbols = marks[ends[1:]] - marks[ends[:-1]]
        shares, repeat = [], np.zeros(n_docs, np.int64)
        for n, starts in coverage_starts(ids, doc, lengths):
            inside = covered(starts, n)
            if n == BASE_N:
                repeat = total(inside).astype(np.int64)
            if n in limits:
                shares.append(total(inside * size) / np.maximum(chars, 1))
        lines = [line_repeats(t) for t in texts.to_pylist()]
        dup_lines = np.array([a for a, _ in lines], np.int64)
        shares.append(np.array([b for _, b in lines], float) / np.maximum(chars, 1))
        failed = (counts < rules.min_words) | (100 * repeat > rules.base_percent * counts)
        over = symbols > rules.symbols_per_word * np.maximum(counts, 1)
        for share, most in zip(shares, [m for _, m in sorted(rules.coverage)] + [rules.lines]):
            over |= share > most
        return [
            *(pa.array(x, pa.int64()) for x in (counts, chars, symbols, dup_lines, repeat)),
            pa.array(failed),
            pa.array(~failed & ~over),
            *(pa.array(x, pa.float64()) for x in shares),
        ]

    return work


def judge_repetition(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    rules: RepetitionRules = RepetitionRules(),
    prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` of every document (default: all) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept and the coverages, named with ``prefix``."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField(prefix + n, T.LongType()) for n in longs]
    fields += [T.StructField(prefix + n, T.BooleanType()) for n in ("base_failed", "kept")]
    fields += [T.StructField(prefix + n, T.DoubleType()) for n in rules.columns()]
    return map_texts(docs, text, docs.columns if keep is None else keep, lambda: _measure(rules), fields)
