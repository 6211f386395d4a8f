"""Phrases that occur together more often than their parts would by chance.

First pass: every phrase of 1 to ``longest`` words becomes a 64-bit hash. The top bits name one
of the hash partitions. A task counts the hashes of a slice of texts: those that reach the
threshold inside the slice are frequent for sure and travel as bare hashes, however often they
occur; the rest travel with their counts. The task of a hash partition merges the counts into a
Misra-Gries summary. Its capacity exceeds the mass of those counts divided by the threshold, so
what it takes off in total is below the threshold and every frequent phrase survives. Survivors
leave as bits of a filter, one block a partition.

Second pass: the texts are read again, and only phrases whose bits are set, and whose first words
passed as well, are counted, this time exactly and by their words. The filter has at most
``filter_bytes``; should it ever be full, more phrases are counted and none is lost.

Scores, cuts and the removal of phrases inside longer ones are joins of the counted phrases.

Null texts are empty and null languages are ``und``. Repeated rows and rows with one id all count.
An empty table gives no rows. Equal scores go to the larger count, then to the smaller phrase in
UTF-8 byte order. Extra columns are not read, so no name can clash. A text is never cut: a very
long one makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import KeyFilter, byte_slices, col, filter_block, flat_bytes, mix64, shared_table, split_key, word_hashes
from skein.session import shuffle_partitions

#: Characters between pieces, and those between words; fixed values.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

#: Bytes of text whose phrases a task holds at once.
SLICE_BYTES = 4 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PhraseSettings:
    longest: int = 5
    threshold: int = 100
    #: A phrase goes if a longer one around it has at least this share of its count, in percent.
    inside_percent: int = 100
    top: int = 2000
    #: Counters wanted in the summary of one hash partition; more data means more partitions.
    counters: int = 1 << 17
    filter_bytes: int = 64 << 20


class Words:
    """The words of a slice of texts, one after another."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        kinds = np.zeros(256, np.uint8)
        kinds[list(BLANKS)], kinds[list(BREAKS)] = 1, 2
        data, ends = flat_bytes(pc.ascii_lower(texts))
        data = data[: ends[-1]]
        kind = kinds[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, bool)  # a text starts or ends before this byte
        edge[ends] = True
        after = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        starts = np.flatnonzero(inside & (~after | edge[:-1]))
        before = np.concatenate([inside[1:], [False]]) if len(data) else inside
        lasts = np.flatnonzero(inside & (~before | edge[1:]))
        doc = np.searchsorted(ends, starts, side="right") - 1
        self.piece = np.cumsum(kind == 2)[starts] + doc  # ascends from piece to piece
        offsets = np.concatenate([[0], np.cumsum(lasts - starts + 1)])
        held = pa.py_buffer(data[inside].tobytes())
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), held).dictionary_encode()
        self.values = found.dictionary
        self.number = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Words, first places and hashes of all phrases of one length after the other."""
        word = word_hashes(self.values)[self.number] if len(self.number) else np.zeros(0, np.uint64)
        seed = word_hashes(self.langs)[self.lang] if len(self.number) else word
        rolling = mix64(word ^ (seed * _STEP))
        at = np.arange(len(word))
        for n in range(1, longest + 1):
            if n > 1:
                fits = np.flatnonzero(at + n - 1 < len(word))
                fits = fits[self.piece[at[fits]] == self.piece[at[fits] + n - 1]]
                at = at[fits]
                rolling = mix64(rolling[fits] * _STEP + word[at + n - 1])
            yield n, at, rolling


class Summary:
    """A mergeable Misra-Gries summary: what it takes off all counters together stays below
    mass / capacity, and ``lost`` tells how much any counter can be short of."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > 8 * self.capacity:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)]).astype(np.int64)
        self.waiting, self.n_waiting = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first)
        over = len(self.keys) - self.capacity
        if over > 0:  # at least capacity + 1 counters lose the same amount
            off = int(np.partition(self.counts, over - 1)[over - 1])
            self.lost += off
            stay = self.counts > off
            self.keys, self.counts = self.keys[stay], self.counts[stay] - off

    def survivors(self, threshold: int) -> np.ndarray:
        """Every key whose true count may reach the threshold."""
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def _read(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(col(text), F.lit("")).alias("text"), F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang")
    )


def _slices(batches) -> Iterator[Words]:
    for batch in batches:
        sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
        for start, n in byte_slices(sizes, SLICE_BYTES):
            yield Words(*(pa.concat_arrays([batch.column(c).slice(start, n)]) for c in (0, 1)))


def _summaries(rows: DataFrame, settings: PhraseSettings) -> tuple[int, DataFrame]:
    """The bits that name a hash partition, and each partition's block of the filter."""
    spark, threshold = rows.sparkSession, settings.threshold
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word and the sign behind it hardly take less than four bytes; only memory depends on this
    mass = size * settings.longest // 4
    wanted = max(shuffle_partitions(spark), -(-mass // (threshold * settings.counters)))
    bits = max(1, (wanted - 1).bit_length())
    count_type = np.min_scalar_type(threshold)

    def count(batches):
        for words in _slices(batches):
            keys, counts = np.unique(np.concatenate([h for _, _, h in words.hashes(settings.longest)]), return_counts=True)
            part, keys = split_key(keys, bits)
            parts, first = np.unique(part, return_index=True)
            for p, start, stop in zip(parts.tolist(), first, [*first[1:], len(part)]):
                key, n = keys[start:stop], counts[start:stop]
                sure = n >= threshold
                mass = int(n[~sure].sum())
                blobs = key[sure].tobytes(), key[~sure].tobytes(), n[~sure].astype(count_type).tobytes()
                yield pa.RecordBatch.from_pydict(
                    {"part": [p, p], "mass": [mass, None], "sure": [None, blobs[0]], "keys": [None, blobs[1]], "counts": [None, blobs[2]]},
                    schema=pa.schema(
                        [("part", pa.int32()), ("mass", pa.int64()), ("sure", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]
                    ),
                )

    def summarise(batches):
        """One hash partition after the other, the rows with its mass in front."""
        now, mass, summary, sure = None, 0, None, []

        def block():
            keys = np.unique(np.concatenate([*sure, summary.survivors(threshold)])) if summary else np.zeros(0, np.uint32)
            made = filter_block(keys, max(8, settings.filter_bytes >> bits))
            return pa.RecordBatch.from_pydict(
                {"part": [now], "survivors": [len(keys)], "block": [made]},
                schema=pa.schema([("part", pa.int32()), ("survivors", pa.int64()), ("block", pa.binary())]),
            )

        for batch in batches:
            for p, m, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "mass", "sure", "keys", "counts"))):
                if p != now:
                    if now is not None:
                        yield block()
                    now, mass, summary, sure = p, 0, None, []
                if m is not None:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(mass // threshold + 1)
                sure.append(np.frombuffer(blobs[0], np.uint32))
                summary.add(np.frombuffer(blobs[1], np.uint32), np.frombuffer(blobs[2], count_type))
        if now is not None:
            yield block()

    counted = rows.mapInArrow(count, "part int, mass long, sure binary, keys binary, counts binary")
    dealt = counted.repartitionById(1 << bits, F.col("part")).sortWithinPartitions("part", F.col("mass").asc_nulls_last())
    return bits, shared_table(dealt.mapInArrow(summarise, "part int, survivors long, block binary"), "phrase-filter")


def _count_survivors(rows: DataFrame, settings: PhraseSettings, bits: int, blocks: DataFrame) -> DataFrame:
    """lang, phrase, words, n: exact counts of at least the threshold, and a row with a null
    phrase for all words of each language."""
    # at most filter_bytes, or 8 bytes a partition
    held = {p: bytes(b) for p, b in blocks.select("part", "block").collect()}
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def count(batches):
        wanted = KeyFilter(shared.value, bits)
        for words in _slices(batches):
            langs, values, number = words.langs, words.values, words.number
            found = [_Found(np.zeros(len(langs), np.int64), langs, pa.nulls(len(langs), pa.large_string()), 0, np.bincount(words.lang, minlength=len(langs)))]
            name = words.lang * len(values) + number  # of the phrase at each place; equal for equal phrases
            alive = np.ones(len(number), bool)
            for n, at, keys in words.hashes(settings.longest):
                stay = alive[at]
                at, keys = at[stay], keys[stay]
                stay = wanted.passes(keys)
                at, keys = at[stay], keys[stay]
                alive = np.zeros(len(number), bool)
                alive[at] = True
                key = name[at] if n == 1 else name[at] * len(values) + number[at + n - 1]
                _, first, again, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                name[at] = again
                place = at[first]
                parts = [values.take(pa.array(number[place + k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                part, _ = split_key(keys[first], bits)
                found.append(_Found(part, langs.take(pa.array(words.lang[place])), phrase, n, times))
            yield _by_part(found)

    def add(batches):
        """Sums of what arrives, in memory up to ``counters`` phrases; then they go on as they are."""
        held = None
        for batch in batches:
            lists = [batch.column(c).flatten() for c in ("lang", "phrase", "words", "n")]
            new = pa.table(lists, names=["lang", "phrase", "words", "n"])
            held = new if held is None else pa.concat_tables([held, new])
            if len(held) > 2 * settings.counters:
                held = _sums(held)
                if len(held) > settings.counters:
                    yield from held.to_batches()
                    held = None
        if held is not None:
            yield from _sums(held).to_batches()

    counted = rows.mapInArrow(count, "part int, lang array<string>, phrase array<string>, words array<int>, n array<long>")
    parts = counted.repartitionById(1 << bits, F.col("part")).mapInArrow(add, "lang string, phrase string, words int, n long")
    summed = parts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return summed.where(F.col("phrase").isNull() | (F.col("n") >= settings.threshold))


@dataclass
class _Found:
    """Phrases of one length in a slice: hash partition, language, phrase, words and occurrences."""

    part: np.ndarray
    lang: pa.Array
    phrase: pa.Array
    words: int
    n: np.ndarray


def _by_part(found: list[_Found]) -> pa.RecordBatch:
    """One row for each hash partition, with lists of its phrases."""
    part = np.concatenate([f.part for f in found])
    order = np.argsort(part, kind="stable")
    parts, start = np.unique(part[order], return_index=True)
    ends = pa.array(np.append(start, len(part)).astype(np.int32))
    columns = [
        pa.concat_arrays([f.lang for f in found]).cast(pa.string()),
        pa.concat_arrays([f.phrase for f in found]).cast(pa.string()),
        pa.array(np.concatenate([np.full(len(f.n), f.words, np.int32) for f in found])),
        pa.array(np.concatenate([f.n for f in found]), pa.int64()),
    ]
    lists = [pa.ListArray.from_arrays(ends, c.take(pa.array(order))) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *lists], names=["part", "lang", "phrase", "words", "n"])


def _sums(counted: pa.Table) -> pa.Table:
    keys = ["lang", "phrase", "words"]
    return counted.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).combine_chunks()


def count_phrases(
    docs: DataFrame, settings: PhraseSettings = PhraseSettings(), *, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """lang, phrase, words, n: all phrases of 1 to ``longest`` words that occur at least
    ``threshold`` times in the texts of a language, with exact counts, and for each language one
    row with a null phrase, 0 words and the number of all its word occurrences."""
    rows = _read(docs, text, lang)
    bits, blocks = _summaries(rows, settings)
    return shared_table(_count_survivors(rows, settings, bits, blocks), "phrase-counts")


SALTS = 16


def _salted_join(left: DataFrame, right: DataFrame, on: list[str], by: Column) -> DataFrame:
    """An inner join whose hot keys on the left are spread over ``SALTS`` tasks."""
    spread = right.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [*on, "salt"]).drop("salt")


def mine_phrases(
    docs: DataFrame, settings: PhraseSettings = PhraseSettings(), *, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a (its count), l, r (counts
    of the two parts of its lowest-scoring cut), n (words of the language) and score, which is
    floor(1000 * a * n / (l * r))."""
    counted = count_phrases(docs, settings, text=text, lang=lang)
    totals = counted.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("total"))
    frequent = counted.where(F.col("phrase").isNotNull())
    candidates = frequent.where(F.col("words") >= 2).withColumn("word", F.split("phrase", " "))

    def run(start, length) -> Column:
        return F.array_join(F.slice("word", start, length), " ")

    # a longer phrase never occurs more often than one inside it
    inner = candidates.where(F.col("words") >= 3).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    around = inner.select("lang", run(F.col("start"), F.col("size")).alias("phrase"), "n")
    around = around.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = candidates.join(around, ["lang", "phrase"], "left")
    kept = kept.where(~F.coalesce(100 * F.col("longer") >= settings.inside_percent * F.col("n"), F.lit(False)))

    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "cut", F.col("n").alias("a"),
        run(F.lit(1), F.col("cut")).alias("head"), run(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("tail"),
    )
    for part, name in (("head", "l"), ("tail", "r")):
        counts = frequent.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        cuts = _salted_join(cuts, counts, ["lang", part], F.col("phrase"))
    cuts = _salted_join(cuts, totals, ["lang"], F.col("phrase"))
    wide = "decimal(19,0)"
    cuts = cuts.withColumn("over", F.col("a").cast(wide) * F.col("total").cast(wide) * F.lit(1000).cast("decimal(4,0)"))
    cuts = cuts.withColumn("score", F.expr(f"over div (cast(l as {wide}) * cast(r as {wide}))"))
    lowest = cuts.groupBy("lang", "phrase").agg(
        F.min_by(F.struct("a", "l", "r", F.col("total").alias("n"), "score"), F.struct("score", "cut")).alias("best")
    )
    scored = lowest.select("lang", "phrase", "best.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each salt, then the first of those: no task holds a whole language
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):
        ranked = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")
        salted = salted.withColumn("rank", ranked).where(F.col("rank") <= settings.top)
    return salted.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
