"""Toxicity by compression distance.

Two zstandard dictionaries share a base trained by zstandard on ordinary text. The toxic one
adds the words typical of toxic documents, the ordinary one those most frequent in ordinary
documents, padded to the same length; every word stands between two fixed marks. Typical means:
seen behind at least ``min_contexts`` different words in toxic documents (copies of one document
count once that way) and ``lift`` times as often, per context, as in ordinary ones.

A text is read in windows of one word between the same marks. The gain of a window is its
compressed length under the ordinary dictionary less that under the toxic one: a word that the
toxic dictionary holds is one match together with both marks, any other costs two matches and
its letters. How often each gain occurs in toxic and in ordinary training documents gives a
log likelihood ratio per gain (0 for gains that training never saw). A logistic regression with
weights of 0 or more on a document's mean ratio, top three and maximum gives its score; 0.5 is the
calibrated threshold. No feature is a sum over the document and none is squared, so a text is not
flagged for its length alone.

Labels are used from at most ``toxic_rows`` and ``ordinary_rows`` labelled documents (those with
the smallest hashes of their ids). Words are runs of letters and bytes outside ASCII, A-Z
lower-cased. Null and empty texts have no window and get the score of a text without signs.
With labels of one kind alone every score is that label, with none it is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import col, flat_bytes, map_texts, ragged, share, split_words

_MARK_A, _MARK_B = bytes(range(1, 17)), bytes(range(128, 144))
_LOW, _HIGH = -8, 12
_GAINS = _HIGH - _LOW + 1
_WORD_BYTES = np.array(
    [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8
)


@dataclass(frozen=True)
class ToxicitySettings:
    toxic_rows: int = 2000
    ordinary_rows: int = 6000
    base_rows: int = 500
    base_bytes: int = 4096
    min_contexts: int = 6
    lift: float = 20.0
    max_words: int = 4096


def toxic_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers, words per text and distinct words; other bytes part words."""
    data, ends = flat_bytes(texts)
    letters = _WORD_BYTES[data[: ends[-1]]].tobytes()  # as many bytes as before
    own = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(letters))
    return split_words(own)


class Lengths:
    """Compressed lengths of windows under both dictionaries; made once in a task."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        self.zstd = zstandard
        parameters = zstandard.ZstdCompressionParameters.from_level(
            9,
            source_size=128,
            dict_size=max(len(ordinary), 1024),
            strategy=zstandard.STRATEGY_LAZY,
            min_match=4,
            write_checksum=False,
            write_content_size=False,
            write_dict_id=False,
        )
        self.sides = []
        for held in (ordinary, toxic):
            known = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=parameters)
            self.sides.append(zstandard.ZstdCompressor(dict_data=known, compression_params=parameters))

    def gains(self, words: pa.Array) -> np.ndarray:
        """Gain of the window of each word, within its limits, counted from the lowest."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        data, ends = flat_bytes(words)
        size, marks = np.diff(ends), len(_MARK_A) + len(_MARK_B)
        begin = np.cumsum(size + marks) - size - marks
        window = np.empty(int(size.sum()) + n * marks, np.uint8)
        for offset, mark in ((begin, _MARK_A), (begin + len(_MARK_A) + size, _MARK_B)):
            for k, byte in enumerate(mark):
                window[offset + k] = byte
        window[ragged(begin + len(_MARK_A), size)] = data[ends[0] : ends[-1]]
        places = np.stack([begin, size + marks], 1).astype("<u8").tobytes()
        lengths = []
        for side in self.sides:
            found = side.multi_compress_to_buffer(self.zstd.BufferWithSegments(window.tobytes(), places), threads=1)
            lengths.append(np.fromiter(map(len, found), np.int64, count=n))
        return np.clip(lengths[0] - lengths[1], _LOW, _HIGH) - _LOW

    def histograms(self, texts: pa.Array) -> np.ndarray:
        """How often each gain occurs in each text."""
        numbers, counts, words = toxic_words(texts)
        text = np.repeat(np.arange(len(counts)), counts)
        gains = self.gains(words)[numbers]
        return np.bincount(text * _GAINS + gains, minlength=len(counts) * _GAINS).reshape(-1, _GAINS)


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(_GAINS))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(3))
    spread: np.ndarray = field(default_factory=lambda: np.ones(3))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None  # the score of every text, where nothing can be learnt

    def features(self, histograms: np.ndarray) -> np.ndarray:
        number = histograms.sum(1)
        mean = histograms @ self.ratio / np.maximum(number, 1)
        order = np.argsort(-self.ratio, kind="stable")
        behind = np.cumsum(histograms[:, order], 1)
        in_top = np.diff(np.minimum(behind, 3), prepend=0, axis=1)
        first = np.argmax(behind > 0, 1)
        most = np.where(number > 0, self.ratio[order][first], 0.0)
        return np.stack([mean, in_top @ self.ratio[order], most], 1)

    def score(self, histograms: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(histograms), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.design(histograms) @ self.weights, -500, 500)))

    def design(self, histograms: np.ndarray) -> np.ndarray:
        """Features in standard units, and 1; far values are held at 6."""
        z = np.clip((self.features(histograms) - self.centre) / self.spread, -6, 6)
        return np.concatenate([z, np.ones((len(z), 1))], 1)


def monotone_fit(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with weights of 0 or more; the last column is the constant. A feature
    whose weight comes out below 0 is left out, the lowest first."""
    weights, used = np.zeros(z.shape[1]), np.arange(z.shape[1])
    while True:
        part, found = z[:, used], np.zeros(len(used))
        ridge = np.diag([*[0.5] * (len(used) - 1), 1e-6])
        for _ in range(40):  # Newton's method on the penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(part @ found, -30, 30)))
            slope = part.T @ (p - y) + ridge @ found
            found -= np.linalg.solve(part.T @ (part * (p * (1 - p))[:, None]) + ridge, slope)
        if len(used) == 1 or found[:-1].min() >= 0:
            weights[used] = found
            return weights
        used = np.delete(used, np.argmin(found[:-1]))


def _sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, settings: ToxicitySettings) -> DataFrame:
    """Text and label of a bounded number of labelled documents."""
    known = labels.select(col(doc_id).alias("id"), col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    order = F.xxhash64("id")
    parts = [
        known.where(F.col("label") == kind).dropDuplicates().orderBy(order, "id").limit(rows)
        for kind, rows in ((1, settings.toxic_rows), (0, settings.ordinary_rows))
    ]
    # at most toxic_rows + ordinary_rows ids: a proven bound
    drawn = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.where(col(text).isNotNull()).join(drawn, col(doc_id) == drawn["id"]).select(
        col(text).alias("text"), drawn["label"].alias("label"), drawn["id"].alias("id")
    )


def _contexts(sample: DataFrame) -> DataFrame:
    """How many different words stand before each word, per label."""
    schema = T.StructType(
        [T.StructField("label", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("word", T.StringType())]
    )

    def pairs(batches):
        for batch in batches:
            for kind in (0, 1):
                texts = batch.column("text").filter(pc.equal(batch.column("label"), kind))
                numbers, counts, words = toxic_words(pa.concat_arrays([texts]))
                if not len(numbers):
                    continue
                before = np.concatenate([[0], numbers[:-1] + 1])
                heads = (np.cumsum(counts) - counts)[counts > 0]
                before[heads] = 0
                width = len(words) + 1
                keys = np.unique(numbers * width + before)
                words = words.cast(pa.string())
                names = pa.concat_arrays([pa.array([""], pa.string()), words])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), kind, np.int32)), names.take(pa.array(keys % width)), words.take(pa.array(keys // width))],
                    names=schema.names,
                )

    distinct = sample.select("text", "label").mapInArrow(pairs, schema).distinct()
    return distinct.groupBy("word").agg(
        F.sum(F.col("label")).alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary")
    )


def _dictionaries(sample: DataFrame, settings: ToxicitySettings) -> tuple[bytes, bytes]:
    import zstandard

    found = _contexts(sample).where(F.length("word") > 2)
    totals = found.agg(F.sum("toxic"), F.sum("ordinary")).first()
    share = F.col("toxic") / F.lit(max(totals[0] or 0, 1))
    usual = (F.col("ordinary") + 0.5) / F.lit(max(totals[1] or 0, 1))
    typical = found.where((F.col("toxic") >= settings.min_contexts) & (share > settings.lift * usual))
    toxic = [r["word"] for r in typical.orderBy(F.desc("toxic"), "word").limit(settings.max_words).collect()]
    common = found.where("ordinary > 0").orderBy(F.desc("ordinary"), "word").limit(max(len(toxic), 1)).collect()
    texts = sample.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(settings.base_rows).select("text").collect()
    pieces = []
    for row in texts:
        words = row["text"].lower().encode().split()
        pieces += [b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]
    try:
        base = zstandard.train_dictionary(settings.base_bytes, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        base = b"".join(pieces)[: settings.base_bytes]
    sides = [b"".join(_MARK_A + w.encode() + _MARK_B for w in words) for words in ([r["word"] for r in common][::-1], toxic[::-1])]
    longest = max(map(len, sides))
    ordinary, toxic_side = (base + side.rjust(longest, b"\0") + _MARK_A + _MARK_B for side in sides)
    return ordinary, toxic_side


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    settings: ToxicitySettings = ToxicitySettings(),
) -> ToxicityModel:
    """Learn from labelled documents; nothing but their texts and labels is used."""
    sample = _sample(docs, labels, text, doc_id, label, settings).persist()
    try:
        kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        if len(kinds) < 2:
            return ToxicityModel(constant=float(next(iter(kinds), 0)))
        ordinary, toxic = _dictionaries(sample, settings)
        schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("h", T.ArrayType(T.LongType()))])

        def measure(batches):
            lengths = None
            for batch in batches:
                lengths = lengths or Lengths(ordinary, toxic)
                found = lengths.histograms(pa.concat_arrays([batch.column("text")]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(found.tolist(), pa.list_(pa.int64()))], names=schema.names
                )

        rows = sample.select("text", "label").mapInArrow(measure, schema).collect()
    finally:
        sample.unpersist()
    y = np.array([r["label"] for r in rows], float)
    x = np.array([r["h"] for r in rows], float)
    seen = [x[y == k].sum(0) for k in (0, 1)]
    total = sum(k.sum() for k in seen) + 1e-9
    # the same rate is added to both kinds, so that a gain that neither has says nothing
    rates = [(k + (k.sum() + 1e-9) / total) / (k.sum() + _GAINS * (k.sum() + 1e-9) / total + 1e-9) for k in seen]
    model = ToxicityModel(ordinary, toxic, np.log(rates[1]) - np.log(rates[0]))
    features = model.features(x)
    model.centre, model.spread = features.mean(0), features.std(0) + 1e-9
    model.weights = monotone_fit(model.design(x), y)
    return model


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` of every document (default: all) with score and predicted (1 from 0.5
    on), named with ``prefix``."""
    shared = share(docs.sparkSession, model)

    def make():
        held = shared()
        lengths = Lengths(held.ordinary, held.toxic) if held.constant is None else None

        def work(texts: pa.Array) -> list[pa.Array]:
            found = lengths.histograms(texts) if lengths else np.zeros((len(texts), _GAINS))
            score = held.score(found)
            return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

        return work

    fields = [T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "predicted", T.IntegerType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, make, fields)
