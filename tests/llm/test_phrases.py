"""Phrase mining against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm.phrases import PhraseSettings, Summary, count_phrases, mine_phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, longest, threshold, inside, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    frequent = {k: n for k, n in counts.items() if n >= threshold}
    candidates = {k: n for k, n in frequent.items() if len(k[1]) > 1}
    longer = Counter()
    for (lang, w), n in candidates.items():
        for size in range(2, len(w)):
            for k in range(len(w) - size + 1):
                key = lang, w[k : k + size]
                longer[key] = max(longer[key], n)
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) in longer and 100 * longer[lang, w] >= inside * a:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    result = set()
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            result.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return result, {(lang, " ".join(w), len(w), n) for (lang, w), n in frequent.items()}, totals


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["the", "of", "naïve", "中文", "x.y", "A", "B", "c;", "d,", "end.", "new\tline", "tab\n", "q\x0bq", " ", *(f"w{k}" for k in range(40))]
    weights = [1 / (k + 1) for k in range(len(words))]
    out = [(" ".join(r.choices(words, weights, k=r.randint(0, 60))), r.choice(["en", "de", None, "und"])) for _ in range(300)]
    out += [("same words again and again " * 40, "en")] * 5 + [(None, "en"), ("", None), (" \t\n", "de"), (None, None), ("solo", "fr")]
    return out


SCHEMA = "text string, lang string, n long, phrase string"


@pytest.mark.parametrize(("threshold", "inside", "top", "counters"), [(3, 100, 2000, 1 << 17), (5, 60, 7, 50), (40, 100, 2000, 200)])
def test_phrases_equal_plain_counts(spark, rows, threshold, inside, top, counters):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(5)
    settings = PhraseSettings(threshold=threshold, inside_percent=inside, top=top, counters=counters)
    want, frequent, totals = plain(rows, 5, threshold, inside, top)
    counted = {tuple(r) for r in count_phrases(docs, settings).collect()}
    assert {r for r in counted if r[1] is not None} == frequent
    assert {(r[0], r[3]) for r in counted if r[1] is None} == {(k, totals[k]) for k in {row[1] or "und" for row in rows}}
    assert {tuple(r) for r in mine_phrases(docs, settings).collect()} == want


def test_a_full_filter_loses_nothing(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    settings = PhraseSettings(threshold=3, filter_bytes=1)
    got = {tuple(r) for r in count_phrases(docs, settings).where("phrase is not null").collect()}
    assert got == plain(rows, 5, 3, 100, 2000)[1]


def test_empty_table(spark):
    assert mine_phrases(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_over_64_bits(spark):
    rows = [("aa bb", "en")] * 3
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    (got,) = mine_phrases(docs, PhraseSettings(threshold=2)).collect()
    assert tuple(got) == ("en", 1, "aa bb", 3, 3, 3, 6, 2000)
    row = spark.sql(
        "select (cast(9000000000000000 as decimal(19,0)) * cast(8000000000000 as decimal(19,0)) * cast(1000 as decimal(4,0)))"
        " div (cast(7000000000000000 as decimal(19,0)) * cast(9000000000000 as decimal(19,0)))"
    ).first()[0]
    assert row == 9000000000000000 * 8000000000000 * 1000 // (7000000000000000 * 9000000000000)


def test_summaries_keep_every_frequent_key():
    r = np.random.default_rng(1)
    keys = r.zipf(1.3, 60_000).astype(np.uint32) % 5000
    true = Counter(keys.tolist())
    for threshold in (50, 200):
        summary = Summary(len(keys) // threshold + 1)
        for part in np.array_split(keys, 37):
            key, n = np.unique(part, return_counts=True)
            summary.add(key, n)
            summary.merge()
            assert len(summary.keys) <= summary.capacity
        assert 0 < summary.lost < threshold
        assert {k for k, n in true.items() if n >= threshold} <= set(summary.survivors(threshold).tolist())
        held = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        assert all(held.get(k, 0) <= n <= held.get(k, 0) + summary.lost for k, n in true.items())
