"""URL filter: host and path rules, and a logistic regression for what no rule covers.

The model sees hashed character n-grams of the host and of the path (marked apart, ends marked)
and learns from a small labelled URL table of its own (``url_table``, or one that is given), never
from the rules or the pages. Each n-gram that a URL has counts once; vectors have length one; kinds
count by their rows, so that a URL unlike any in the table is as likely unwanted as the table's
share. Training is full-batch gradient descent in numpy, the same for the same table. With labels
of one kind alone the method gives that verdict, with none it allows.

Scoring reads whole URLs in Arrow batches. A null URL and one without ``://`` have an empty host
and path. Repeated rows stay; every row has a verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import UPPER, col, flat_bytes, free_name, ragged, refuse_clashes, share
from skein.llm.url_table import labelled_urls

#: (verdict, host, path): fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class UrlModelSettings:
    sizes: tuple[int, ...] = (2, 3, 4, 5)
    buckets: int = 1 << 16
    steps: int = 300
    rate: float = 4.0
    penalty: float = 1e-4


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def with_rule(pages: DataFrame, host: str, path: str, rule: str, verdict: str, rules=RULES) -> DataFrame:
    """Adds the longest rule that fits (null: none) and its verdict."""
    name, found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last to be added is asked first
        fits = ((col(host) == domain) | col(host).endswith("." + domain)) & col(path).startswith(start)
        name = F.when(fits, F.lit(domain + start)).otherwise(name)
        found = F.when(fits, F.lit(kind)).otherwise(found)
    return pages.withColumns({rule: name, verdict: found})


def hashed_grams(hosts: pa.Array, paths: pa.Array, settings: UrlModelSettings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every row in order, and how many each row has."""
    rows, found = [], []
    for seed, values in enumerate((hosts, paths)):
        data, ends = flat_bytes(pa.concat_arrays([values.cast(pa.binary())]))
        size = np.diff(ends)
        # a mark before and behind each value
        padded = np.full(int(size.sum()) + 2 * len(size), 0x01, np.uint64)
        begin = np.cumsum(size + 2) - size - 2
        padded[ragged(begin + 1, size)] = data[ragged(ends[:-1], size)]
        row = np.repeat(np.arange(len(size)), size + 2)
        value = np.full(len(padded), 0x9E3779B97F4A7C15 + seed, np.uint64)
        for n in range(1, max(settings.sizes) + 1):
            value = value[: len(padded) - n + 1] * np.uint64(0x100000001B3) + padded[n - 1 :]
            if n in settings.sizes:
                inside = row[: len(value)] == row[n - 1 :]
                mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append(((mixed >> np.uint64(32)) % np.uint64(settings.buckets)).astype(np.int64)[inside])
                rows.append(row[: len(value)][inside])
    keys = np.unique(np.concatenate(rows) * settings.buckets + np.concatenate(found))
    return keys % settings.buckets, np.bincount(keys // settings.buckets, minlength=len(hosts))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float
    settings: UrlModelSettings

    def block_probability(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        if not len(hosts):
            return np.zeros(0)
        grams, counts = hashed_grams(hosts, paths, self.settings)
        row = np.repeat(np.arange(len(hosts)), counts)
        total = np.bincount(row, self.weights[grams], minlength=len(hosts)) / np.sqrt(np.maximum(counts, 1))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def train(table: pa.Table, settings: UrlModelSettings) -> UrlModel:
    """Fit on rows host, path, block (1 or 0)."""
    hosts, paths = (table[c].combine_chunks() for c in ("host", "path"))
    label = table["block"].to_numpy().astype(float)
    weights, bias = np.zeros(settings.buckets), 0.0
    if not len(label) or label.min() == label.max():
        return UrlModel(weights, 20.0 if len(label) and label[0] else -20.0, settings)
    grams, counts = hashed_grams(hosts, paths, settings)
    row = np.repeat(np.arange(len(label)), counts)
    value = 1 / np.sqrt(np.maximum(counts, 1))[row]
    share = 1 / len(label)
    for _ in range(settings.steps):
        odds = np.bincount(row, weights[grams] * value, minlength=len(label)) + bias
        miss = (1 / (1 + np.exp(-odds)) - label) * share
        step = np.bincount(grams, miss[row] * value, minlength=settings.buckets)
        weights -= settings.rate * (step + settings.penalty * weights)
        bias -= settings.rate * miss.sum()
    return UrlModel(weights, float(bias), settings)


def filter_urls(
    pages: DataFrame,
    *,
    url: str = "url",
    keep: list[str] | None = None,
    rules=RULES,
    settings: UrlModelSettings = UrlModelSettings(),
    labelled: pa.Table | None = None,
    prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` of every page (default: all) with host, path, rule, verdict and
    block_score (the model's probability, for every row), named with ``prefix``. ``labelled`` (host,
    path, block) takes the place of the table that comes with the package."""
    keep = pages.columns if keep is None else keep
    host, path, rule, verdict, score = (prefix + n for n in ("host", "path", "rule", "verdict", "block_score"))
    refuse_clashes(keep, [host, path, rule, verdict, score])
    h, p = url_parts(col(url))
    inner = [free_name(pages, n) for n in ("host_of_row", "path_of_row", "rule_of_row", "verdict_of_row")]
    parts = pages.select(*[col(c) for c in keep], h.alias(inner[0]), p.alias(inner[1]))
    judged = with_rule(parts, *inner, rules=rules)
    shared = share(pages.sparkSession, train(labelled_urls() if labelled is None else labelled, settings))
    schema = T.StructType(
        [judged.schema[c] for c in keep]
        + [T.StructField(n, T.StringType()) for n in (host, path, rule, verdict)]
        + [T.StructField(score, T.DoubleType())]
    )

    def decide(batches):
        model = shared()
        for batch in batches:
            *kept, hosts, paths, found, ruled = batch.columns
            odds = model.block_probability(hosts, paths)
            own = pa.array(np.where(odds >= 0.5, "block", "allow").astype(object), pa.string())
            verdicts = pc.coalesce(ruled, own)
            yield pa.RecordBatch.from_arrays([*kept, hosts, paths, found, verdicts, pa.array(odds)], names=schema.names)

    return judged.mapInArrow(decide, schema)
