"""Language of texts and of their spans.

Training counts byte n-grams of lower-cased words (ends marked) per language, on a sample of
about ``per_language`` labelled documents of each language (all, where there are fewer). A word's
score for a language is the sum of its n-grams' smoothed log probabilities, held within
``swing`` of the best language's, so that one strange word cannot outweigh its neighbours.

Script ranges come first: a word's script is that of its first letter, and only languages with
at least ``script_share`` of their training letters in that script are candidates (all, if none
has). A Viterbi path over the words of a text, with a fixed penalty for each switch, labels
spans; all texts of a slice advance one word at a time together. The language with the most
letters in its spans is the text's, ties go to the name that sorts first, and the score is its
share of the letters. Texts that are null or have no letter are ``und`` with score 0, as are all
texts where there is nothing to learn from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import col, flat_bytes, map_texts, share, split_words

UNKNOWN = "und"

#: First and last code point of scripts, fixed values; letters outside them are of one more script.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F),
    ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F),
    ("Gujarati", 0x0A80, 0x0AFF),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF),
    ("Malayalam", 0x0D00, 0x0D7F),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Hangul syllables", 0xAC00, 0xD7AF),
    ("Ethiopic", 0x1200, 0x137F),
    ("Latin additional", 0x1E00, 0x1EFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
)


@dataclass(frozen=True)
class LanguageSettings:
    sizes: tuple[int, ...] = (2, 3, 4)
    buckets: int = 1 << 16
    per_language: int = 1500
    smoothing: float = 0.3
    swing: float = 12.0
    switch: float = 8.0
    script_share: float = 0.02


def scripts_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Script number of each word's first letter (-1: it has none), and its letters."""
    letters = pc.replace_substring_regex(words, r"\P{L}+", "")
    count = pc.utf8_length(letters).to_numpy(zero_copy_only=False).astype(np.int64)
    first = pc.utf8_slice_codeunits(letters, 0, 1).to_pylist()
    point = np.array([ord(c) if c else 0 for c in first], np.int64)
    starts = np.array([low for _, low, _ in sorted(SCRIPTS, key=lambda s: s[1])])
    ends = np.array([high for _, _, high in sorted(SCRIPTS, key=lambda s: s[1])])
    at = np.searchsorted(starts, point, side="right") - 1
    script = np.where((at >= 0) & (point <= ends[at]), at, len(SCRIPTS))
    return np.where(count > 0, script, -1), count


def word_grams(words: pa.Array, settings: LanguageSettings):
    """For each n-gram length: buckets of all words in order, and how many each word has."""
    marked = pc.binary_join_element_wise(pa.scalar(""), words, pa.scalar(""), " ")
    data, ends = flat_bytes(pa.concat_arrays([marked]))
    data = data[: ends[-1]].astype(np.uint64)
    word = np.repeat(np.arange(len(words)), np.diff(ends))
    value = np.zeros(len(data), np.uint64)
    for n in range(1, max(settings.sizes) + 1):
        value = (value[: max(len(data) - n + 1, 0)] << np.uint64(8)) | data[n - 1 :]
        if n in settings.sizes:
            inside = word[: len(value)] == word[n - 1 :]
            bucket = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            yield (bucket % np.uint64(settings.buckets)).astype(np.int64)[inside], word[: len(value)][inside]


@dataclass
class LanguageModel:
    names: list[str]
    scores: np.ndarray  # (n-gram lengths * buckets, languages)
    candidates: np.ndarray  # (scripts, languages)
    settings: LanguageSettings

    def word_scores(self, words: pa.Array, script: np.ndarray) -> np.ndarray:
        total = np.zeros((len(words), len(self.names)), np.float64)
        for k, (bucket, word) in enumerate(word_grams(words, self.settings)):
            found = self.scores[bucket + k * self.settings.buckets]
            for language in range(len(self.names)):
                total[:, language] += np.bincount(word, found[:, language], minlength=len(words))
        total = np.where(self.candidates[script], total, -np.inf)
        best = total.max(1, keepdims=True)
        return np.maximum(total - best, -self.settings.swing).astype(np.float32)

    def paths(self, scores: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Language of every word: the best path of each text, all texts side by side."""
        order = np.argsort(-counts, kind="stable")
        heads = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with a word there
        kind = np.min_scalar_type(len(self.names))  # as wide as the number of languages asks for
        back = np.zeros((len(numbers), len(self.names)), kind)
        value = np.zeros((len(counts), len(self.names)), np.float32)
        stay = np.arange(len(self.names), dtype=kind)
        for t in range(longest):
            n = alive[t]
            at = heads[:n] + t
            now = value[:n]
            if t:
                best = now.argmax(1)
                other = now[np.arange(n), best] - self.settings.switch
                move = other[:, None] > now
                back[at] = np.where(move, best[:, None].astype(kind), stay)
                now = np.where(move, other[:, None], now)
            value[:n] = now + scores[numbers[at]]
        label = np.zeros(len(numbers), kind)
        state = value.argmax(1)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            at = heads[:n] + t
            label[at] = state[:n]
            state[:n] = back[at, state[:n]]
        return label

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language of every word with a letter, its letters, and such words per text."""
        numbers, counts, words = split_words(pc.utf8_lower(texts))
        script, letters = scripts_of(words)
        real = letters[numbers] > 0
        text = np.repeat(np.arange(len(counts)), counts)[real]
        numbers = numbers[real]
        counts = np.bincount(text, minlength=len(counts))
        return self.paths(self.word_scores(words, script), numbers, counts), letters[numbers], counts

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        label, letters, counts = self.spans(texts)
        text = np.repeat(np.arange(len(counts)), counts)
        share = np.bincount(text * len(self.names) + label, letters, minlength=len(counts) * len(self.names))
        share = share.reshape(len(counts), -1)
        total = share.sum(1)
        best = share.argmax(1)
        names = [self.names[b] if t else UNKNOWN for b, t in zip(best, total)]
        return names, np.where(total > 0, share.max(1, initial=0) / np.maximum(total, 1), 0.0)


def train(labelled: DataFrame, text: str, lang: str, doc_id: str, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Learn from rows with a text and a label: one small count table per language."""
    held = labelled.where(col(text).isNotNull() & col(lang).isNotNull()).select(
        col(lang).cast("string").alias("lang"), col(text).alias("text"), F.xxhash64(col(doc_id), col(lang)).alias("draw")
    )
    sizes = {r["lang"]: r["n"] for r in held.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    rate = F.lit(0.0)
    for name in names:
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, settings.per_language / sizes[name]))).otherwise(rate)
    unit = (F.pmod(F.col("draw"), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    sample = held.where(unit < rate).select("lang", "text")
    schema = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())]
    )
    width = settings.buckets * len(settings.sizes)
    n_scripts = len(SCRIPTS) + 1

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0)
            for name in pc.unique(langs).to_pylist():
                texts = batch.column(1).filter(pc.equal(langs, name))
                numbers, _, words = split_words(pc.utf8_lower(texts))
                weight = np.bincount(numbers, minlength=len(words))
                script, letters = scripts_of(words)
                own = found.setdefault(name, np.zeros(width + n_scripts, np.int64))
                real = script >= 0
                own[width:] += np.bincount(script[real], (letters * weight)[real], minlength=n_scripts).astype(np.int64)
                for k, (bucket, word) in enumerate(word_grams(words, settings)):
                    seen = real[word]
                    sums = np.bincount(bucket[seen], weight[word[seen]], minlength=settings.buckets)
                    own[k * settings.buckets : (k + 1) * settings.buckets] += sums.astype(np.int64)
        for name, own in found.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=schema.names
            )

    table = sample.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((width + n_scripts, len(names)))
    row = {name: k for k, name in enumerate(names)}
    language = np.array([row[x] for x in table["lang"].to_pylist()], np.int64)
    counts[table["bucket"].to_numpy(), language] = table["n"].to_numpy()
    scores = np.zeros((width, len(names)), np.float32)
    for k in range(len(settings.sizes)):
        part = counts[k * settings.buckets : (k + 1) * settings.buckets] + settings.smoothing
        scores[k * settings.buckets : (k + 1) * settings.buckets] = np.log(part / part.sum(0))
    letters = counts[width:]
    candidates = letters >= settings.script_share * np.maximum(letters.sum(0), 1)
    candidates |= ~candidates.any(1, keepdims=True)
    return LanguageModel(names, scores, candidates, settings)


def identify(
    docs: DataFrame,
    model: LanguageModel,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` of every document (default: all) with lang_pred and score, named with
    ``prefix``."""
    shared = share(docs.sparkSession, model)

    def make():
        held = shared()

        def work(texts: pa.Array) -> list[pa.Array]:
            names, score = held.predict(texts)
            return [pa.array(names, pa.string()), pa.array(score)]

        return work

    fields = [T.StructField(prefix + "lang_pred", T.StringType()), T.StructField(prefix + "score", T.DoubleType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, make, fields)
