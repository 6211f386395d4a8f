"""The pipeline, stage by stage, against plain Python on a small fixture."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import packing, repetition, toxicity
from skein.llm.common import shared_table
from test_operators import edited, plain_contamination, plain_jaccard, plain_repetition, prose, words

BAD = "vilbrak mordune skerrit gnashol drubbet flaxorn".split()


def with_bad(seed):
    w = prose(seed, 120).split()
    r = np.random.default_rng(seed)
    for at in r.choice(len(w), 24, replace=False):
        w[at] = BAD[r.integers(len(BAD))]
    return " ".join(w)


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    texts = [with_bad(k) if k % 3 == 0 else prose(k, 120) for k in range(90)]
    texts += [edited(texts[1], 5, 1), texts[2], prose(200, 20), "word " * 200, None, "", prose(201, 3000)]
    texts.append(" ".join(prose(202, 100).split()[:50] + prose(900, 40).split() + prose(203, 60).split()))
    rows = [(k, t, "aa", "s", len(t or "")) for k, t in enumerate(texts)]
    items = [("i1", prose(900, 40)), ("i2", prose(901, 40)), ("i3", None)]
    labels = [(k, 1, int(k % 3 == 0)) for k in range(90)]
    sf_dir = str(tmp_path_factory.mktemp("pipeline"))
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id string, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{sf_dir}/{name}.parquet")
    return sf_dir, rows, items, labels


def plain_toxic(model, text):
    sides = toxicity.Lengths(model.ordinary, model.toxic).sides
    histogram = np.zeros((1, toxicity._GAINS))
    for word in "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower()).split():
        window = toxicity._MARK_A + word.encode() + toxicity._MARK_B
        gain = len(sides[0].compress(window)) - len(sides[1].compress(window))
        histogram[0, min(max(gain, toxicity._LOW), toxicity._HIGH) - toxicity._LOW] += 1
    return model.score(histogram)[0] >= 0.5


def plain_kept(text):
    n, _, symbols, _, _, failed, cover = plain_repetition(text)
    rules = repetition.RepetitionRules()
    return not (failed or symbols > rules.symbols_per_word * n or any(c > m for c, (_, m) in zip(cover, rules.coverage)))


def test_stages_equal_plain_ones(spark, fixture):
    sf_dir, rows, items, labels = fixture
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 5], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    want = [r for r in rows if not plain_toxic(model, r[1])]
    # 96 is clean but far longer than any labelled text, and the model flags it (an open fault, see README)
    assert {r[0] for r in rows} - {r[0] for r in want} - {96} == set(range(0, 90, 3))
    wanted = [want]
    wanted.append([r for r in wanted[-1] if plain_kept(r[1])])
    least = {i for i, _, c in plain_jaccard(wanted[-1]) if i == c}
    wanted.append([r for r in wanted[-1] if r[0] in least])
    wanted.append([r for r in wanted[-1] if not plain_contamination(r[1], items)[-1]])
    assert len({len(x) for x in wanted}) == 4
    now = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES, wanted):
        now = shared_table(stage(spark, now, sf_dir), "test-stage")
        assert now.columns == docs.columns
        assert Counter(map(tuple, now.collect())) == Counter(expected), name
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = Counter()
    bins = {}
    for r in packed:
        tokens[r["doc_id"]] += r["n_tokens"]
        bins.setdefault((r["bin"], r["bin_size"]), []).append((r["offset"], r["n_tokens"]))
    assert tokens == {r[0]: len(words(r[1])) + 1 for r in wanted[-1]}
    assert len(bins) == len({b for b, _ in bins})
    for (_, size), held in bins.items():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert size == min(s for s in packing.PackingSettings().sizes if s >= end)


def plain_near_copies(rows, n=5, percent=80):
    """The ids that stay: the least one of each component of linked shingle sets."""
    sets = []
    for i, t in rows:
        w = words(t.lower())
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}))
    root = {i: i for i, _ in sets}
    for a, x in sets:
        for b, y in sets:
            if a < b and 100 * len(x & y) >= percent * len(x | y):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return {i for i, r in root.items() if i == r}


def changed(text, at):
    w = text.split()
    for k in at:
        w[k] = f"changed{k}"
    return " ".join(w)


def test_near_copies_are_judged_on_5_words_and_80_percent(spark):
    base = [prose(300 + k, 200) for k in range(4)]
    texts = [*base, changed(base[0], (20, 70, 120, 170)), changed(base[1], range(10, 200, 30)), changed(base[2], (50,)), base[3], "one two three four"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_near_copies(rows)
    assert 4 not in want and 4 in plain_near_copies(rows, 3, 90) and 5 in want
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want


def test_long_clean_texts_stay(spark, fixture):
    sf_dir, rows, *_ = fixture
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    assert 96 in kept and {r[0] for r in rows} - kept == set(range(0, 90, 3))


def test_no_dead_tables_stay_behind(spark, fixture):
    from pathlib import Path

    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    names = ("stage-", "jaccard-")
    before = {p.name for p in folder.iterdir() if p.name.startswith(names)}
    rows = corpus_pipeline.run(spark, fixture[0])
    left = {p.name for p in folder.iterdir() if p.name.startswith(names)} - before
    assert len(left) == 1 and left.pop().startswith("stage-best-fit") and rows.count() > 0
