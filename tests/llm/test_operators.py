"""The text operators against brute force on small tables with awkward rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from skein.llm import decontaminate, jaccard, language, lattice, packing, repetition, token_ids, toxicity, url_filter
from skein.llm.token_counts import TokenCounter, count_tokens
from skein.llm.units import IdEncoder, id_tables

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the of and to in that it was for on are as with his they at be this from have or by one had not but".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + str(r.randint(0, 60)) for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    base = [prose(k, 120) for k in range(6)]
    texts = [*base, base[0], base[0], *(edited(base[1], k, 1) for k in range(5)), *(edited(base[2], k, 3) for k in range(4))]
    texts += [None, "", " \n\t ", "one", "one", "two words", "a b c", "x" * 5000, "word " * 3000, prose(99, 20000)]
    texts += ["naïve café 中文 \u00a0 x", "it's  the\n\n end's <|endoftext|> x ", "a\nb\na\nb\n" + prose(7, 60)]
    return [(k, t, f"s{k}", 1.5, "clash") for k, t in enumerate(texts)] + [(0, base[0], "s0", 1.5, "clash"), (None, base[3], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, source string, score double, Kept string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, score double, Kept string")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_token_counts_and_ids_equal_the_library():
    r = random.Random(5)
    alphabet = [*" \n\t'abstrevmlldXY01.,!é ü中😀\u0085\u2003", "'s", "'re", "  ", "\n\n", "<|endoftext|>", " the", "ing", "----"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(4000)] + ["", "<|endoftext|>", " "]
    want = [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(VOCABULARY).count(pa.array(texts)).tolist() == [len(w) for w in want]
    ids, counts = IdEncoder(VOCABULARY).encode(pa.array(texts))
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_remembered_pretokens_give_the_same_ids_and_are_encoded_once(monkeypatch):
    texts = [t for k in range(12) for t in (prose(k, 40), f"it's  new{k}\n\n <|endoftext|> naïve 中文 {k}")]
    whole = IdEncoder(VOCABULARY).encode(pa.array(texts))
    sent = []
    plain = IdEncoder._pretoken_ids
    monkeypatch.setattr(IdEncoder, "_pretoken_ids", lambda self, values: sent.extend(values.to_pylist()) or plain(self, values))
    encoder = IdEncoder(VOCABULARY, id_tables(VOCABULARY), remember=True)
    parts = [encoder.encode(pa.array(texts[i : i + 5])) for i in range(0, len(texts), 5)]
    assert all(np.array_equal(np.concatenate(x), y) for x, y in zip(zip(*parts), whole))
    assert len(sent) == len(set(sent)) > 50


def test_common_pretokens_are_not_encoded_again(monkeypatch):
    texts = [t for k in range(12) for t in (prose(k, 40), f"it's  new{k}\n\n <|endoftext|> naïve 中文 {k}")]
    whole = IdEncoder(VOCABULARY).encode(pa.array(texts))
    tables = id_tables(VOCABULARY)
    common = IdEncoder(VOCABULARY, tables).common_pretokens(pa.array(texts[:10]), 40)
    assert len(common[0]) == 40
    sent = []
    plain = IdEncoder._pretoken_ids
    monkeypatch.setattr(IdEncoder, "_pretoken_ids", lambda self, values: sent.extend(values.to_pylist()) or plain(self, values))
    encoder = IdEncoder(VOCABULARY, tables, True, common)
    parts = [encoder.encode(pa.array(texts[i : i + 5])) for i in range(0, len(texts), 5)]
    assert all(np.array_equal(np.concatenate(x), y) for x, y in zip(zip(*parts), whole))
    assert sent and not set(sent) & set(common[0].to_pylist())
    for none in ([], [""]):
        empty = IdEncoder(VOCABULARY, tables).common_pretokens(pa.array(none, pa.string()), 40)
        ids, counts = IdEncoder(VOCABULARY, tables, True, empty).encode(pa.array(texts))
        assert len(empty[0]) == 0 and np.array_equal(ids, whole[0]) and np.array_equal(counts, whole[1])


def test_token_counts_query(docs, rows, empty):
    library = Tokenizer.from_file(VOCABULARY)
    got = count_tokens(docs, VOCABULARY, keep=["doc_id", "score"], limit=100).collect()
    want = Counter()
    for i, t, _, s, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, s, len((t or "").encode()), n, n > 100] += 1
    assert Counter(map(tuple, got)) == want
    assert count_tokens(empty, VOCABULARY).count() == 0


def test_codes_give_random_access():
    r = np.random.default_rng(3)
    for top in (2, 200, 300, 70_000, 2**32 - 1):
        ids = r.integers(0, top, 5000, dtype=np.uint32)
        ids[::7] = top - 1
        held = token_ids.TokenFile(b"".join(token_ids.pack(ids, np.arange(2), np.array([0, 4321, 5000]))))
        assert (held.document(0) == ids[:4321]).all() and (held.document(1) == ids[4321:]).all()
        assert all(held.token(k) == ids[k] for k in (0, 1, 511, 512, 513, 1024, 4999))
        assert (held.tokens(700, 1300) == ids[700:1300]).all() and len(held.tokens(9, 9)) == 0
        with pytest.raises(IndexError):
            held.token(5000)


def test_token_files_round_trip(docs, rows, empty):
    library = Tokenizer.from_file(VOCABULARY)
    got = token_ids.read_token_ids(token_ids.write_token_ids(docs, VOCABULARY, shard_bytes=30_000)).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: r[1])
    start = 0
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    texts = defaultdict(set)
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        texts[i].add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for doc_id, at, n, crc in got:
        assert at == start and (n, crc) in texts[doc_id]
        start += n
    assert token_ids.read_token_ids(token_ids.write_token_ids(empty, VOCABULARY)).count() == 0


def test_token_files_in_a_folder_with_a_blank(docs, tmp_path):
    for name in (str(tmp_path / "with blank" / "a%20b"), f"file://{tmp_path}/other blank"):
        manifest = token_ids.write_token_ids(docs, VOCABULARY, folder=name)
        assert token_ids.read_token_ids(manifest).count() == docs.count()
    assert len(list((tmp_path / "with blank" / "a%20b").glob("*.dac"))) > 0 and len(list((tmp_path / "other blank").glob("*.dac"))) > 0
    with pytest.raises(ValueError, match="no file system"):
        token_ids.open_store("unknown://x/y")


def plain_repetition(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    repeat = len(hit)
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    cover = []
    for n in (4, 6, 8, 10):
        grams = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        inside = {k + j for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] > 1 for j in range(n)}
        cover.append(sum(len(w[k]) for k in inside) / max(sum(map(len, w)), 1))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), repeat, failed, cover


def test_repetition(docs, rows, empty):
    got = repetition.judge_repetition(docs, keep=["doc_id", "text", "Kept"], prefix="q_").collect()
    assert len(got) == len(rows)
    for r in got:
        *want, cover = plain_repetition(r["text"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert [r["q_" + n] for n in names] == want
        assert [r[f"q_cover_{n}"] for n in (4, 6, 8, 10)] == pytest.approx(cover)
        assert not (r["q_kept"] and r["q_base_failed"])
    assert repetition.judge_repetition(empty, prefix="q_").count() == 0


@pytest.mark.parametrize("share, kept", [(0.40, False), (0.32, False), (0.20, True)])
def test_repeated_10_grams_below_the_base_rule(spark, share, kept):
    half = int(200 * share / 2)
    w = [f"w{k:05d}" for k in range(200 - half)]
    text = " ".join(w + w[20 : 20 + half])
    *_, failed, cover = plain_repetition(text)
    assert not failed and cover[-1] == pytest.approx(share)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r["kept"] for r in repetition.judge_repetition(docs).collect()] == [kept]


def plain_jaccard(rows):
    sets = []
    for i, t, *_ in rows:
        w = words(low(t))
        sets.append((i, frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()))
    root = list(range(len(sets)))
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 90 * len(x | y) and root[a] != root[b]:
                old = root[a]
                root = [root[b] if k == old else k for k in root]
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root[k]] = i if least[root[k]] is None else min(i, least[root[k]])
    return Counter((i, len(s), least[root[k]]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_components(docs, rows, empty, block):
    found = jaccard.similar_components(docs, keep=["doc_id"], settings=jaccard.JoinSettings(rows=block)).drop("node")
    assert Counter(map(tuple, found.collect())) == plain_jaccard(rows)
    assert jaccard.similar_components(empty, keep=["doc_id"]).count() == 0


def test_keep_one(docs, rows):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    want = {(i, c) for (i, n, c) in plain_jaccard(rows) if i is not None and (n == 0 or i == c)}
    assert ids == Counter([i for i, _ in want] + [None])


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_guests_meet_hosts_of_like_size_once(spark, percent):
    sizes = [1, 2, 3, 4, 5, 64, 80, 81, 100, 125, 125, 156, 157, 1000, 1250, 1251, 3000] * 3
    rows = [(7, n, size, b"") for n, size in enumerate(sizes)]
    large = spark.createDataFrame(rows, "family long, node long, n_shingles long, keys binary")
    met = jaccard._visits(large, large.where("node % 3 = 0"), jaccard.JoinSettings(percent=percent, rows=2)).collect()
    places = defaultdict(lambda: ([], []))
    for r in met:
        places[r["layer"], r["block"], r["lane"]][r["guest"]].append(r["node"])
    pairs = Counter((g, h) for hosts, guests in places.values() for g in guests for h in hosts)
    like = {(g, h) for g in range(0, len(sizes), 3) for h in range(len(sizes)) if 100 * min(sizes[g], sizes[h]) >= percent * max(sizes[g], sizes[h])}
    assert like <= set(pairs) and set(pairs.values()) == {1}
    assert len(pairs) < 17 * 51 / 2  # not every guest with every host


@pytest.mark.parametrize("listed, join", [(1 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_keep_one_sends_a_short_list_of_copies_to_the_texts(spark, docs, monkeypatch, listed, join):
    monkeypatch.setattr(jaccard, "_LISTED", listed)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert join in next(line for line in plan.splitlines() if "LeftAnti" in line)
        ids = sorted(r["doc_id"] for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(ids) == len(set(ids)) > 0


def test_blocks_lose_no_pair():
    r = np.random.default_rng(1)
    settings = jaccard.JoinSettings()
    for size in (9, 12, 19, 40, 160, 700):
        for _ in range(30):
            a = r.integers(1, 2**63, size, dtype=np.uint64)
            most = 10 * 2 * size // 190 // 2
            b = np.concatenate([a[most:], r.integers(1, 2**63, most, dtype=np.uint64)])
            cut = b[: max(len(b) - (size // 10 - 2 * most), 1)]
            for other in (b, cut if 100 * len(cut) >= 90 * size and not most else b):
                overlap = len(np.intersect1d(a, other))
                if 100 * overlap < 90 * (len(a) + len(other) - overlap):
                    continue
                keys = np.concatenate([np.sort(a), np.sort(other)])
                blocks, counts = jaccard.block_keys(keys, np.array([len(a), len(other)]), settings)
                assert set(blocks[: counts[0]]) & set(blocks[counts[0] :])


def plain_contamination(text, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = split(text), set(), set()
    for item, value in items:
        v = split(value)
        for k in range(max(1, len(v) - size + 1) if v else 0):
            window = v[k : k + size]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_decontamination(spark, docs, rows, empty, slice_bytes):
    items = [("10", prose(3, 120)[50:400]), ("9", "Two, WORDS"), ("9", "one"), ("7", None), ("8", ""), (None, prose(99, 20000)[3000:3200])]
    items.append(("11", prose(1, 12) + " never"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    small = [r for r in rows if len(r[1] or "") < 20_000]
    frame = spark.createDataFrame(small, docs.schema)
    got = decontaminate.find_contamination(frame, bench, keep=["doc_id", "text"], slice_bytes=slice_bytes).drop("spans", "items")
    want = Counter((r[0], r[1], *plain_contamination(r[1], [(i or "", t) for i, t in items])) for r in small)
    assert Counter(map(tuple, got.collect())) == want
    assert any(r[-1] for r in want)
    assert decontaminate.find_contamination(empty, bench, prefix="b_").count() == 0
    assert decontaminate.find_contamination(frame, bench.limit(0), keep=["doc_id"]).where("contaminated").count() == 0


def test_packing(docs, rows, empty):
    settings = packing.PackingSettings(sizes=(64, 128, 256), shard_pieces=10)
    got = packing.pack_documents(docs, keep=["source"], settings=settings).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len(words(r[1])) + 1 for r in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r["bin"]].append((r["offset"], r["n_tokens"], r["bin_size"]))
    for held in bins.values():
        held.sort()
        total = sum(n for _, n, _ in held)
        assert [o for o, _, _ in held] == list(np.cumsum([0] + [n for _, n, _ in held])[:-1])
        assert {s for _, _, s in held} == {min(s for s in settings.sizes if s >= total)}
    per_source = defaultdict(list)
    for r in got:
        per_source[r["source"]].append((r["start"], r["n_tokens"]))
    assert max(n for v in per_source.values() for _, n in v) <= 256
    assert packing.pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs.withColumnRenamed("score", "bin"), keep=["bin"])


def test_packing_opens_and_downsizes():
    settings = packing.PackingSettings(sizes=(4, 8, 16), overhead=1.0)
    bin_of, place, size = packing.pack_pieces([5, 5, 3, 3], settings)
    assert len(size) == 1 and size[0] == 16 and sorted(place) == [0, 5, 10, 13]
    _, _, size = packing.pack_pieces([3], settings)
    assert size.tolist() == [4]
    assert packing.pack_pieces([], settings)[2].tolist() == []


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.Example.NET/en/x?q", "http://net/x", "http://x.net", "https://a.org/fr", "https://org/fr#y"]
    urls += ["http://example.com/de/1", "http://anet/x", "http://a.example.com/en/1", "x://h://net/", "http://é.NET/ü?a", "http://net\n/x"]
    urls += [f"http://www.s{k}.example.{d}/{p}/{k}" for k in range(40) for d, p in (("net", "fr"), ("org", "fr"), ("com", "de"), ("net", "en"))]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls + urls[:3])], "page_id long, url string, Host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, keep=["page_id"]).collect()}
    assert len(got) == len(urls) + 3
    for k, url in enumerate(urls + urls[:3]):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = low(host)
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule[0])
        assert got[k]["verdict"] == (rule[1] or ("block" if got[k]["block_score"] >= 0.5 else "allow"))
    rule_of = {u: got[k]["rule"] for k, u in enumerate(urls)}
    assert rule_of["https://a.org/fr"] is None and rule_of["http://www.s1.example.org/fr/1"] == "org/fr/"
    assert rule_of["http://www.s1.example.net/en/1"] == "example.net/en/" and rule_of["http://example.com/de/1"] == "example.com/de/"
    assert url_filter.filter_urls(pages.limit(0), keep=["page_id"]).count() == 0
    with pytest.raises(ValueError, match="host"):
        url_filter.filter_urls(pages)


def plain_url_model(table, settings):
    """Full-batch descent over dense rows of hashed n-grams."""
    rows = []
    for host, path in zip(table["host"], table["path"]):
        buckets, _ = url_filter.hashed_grams(pa.array([host]), pa.array([path]), settings)
        row = np.zeros(settings.buckets)
        row[buckets] = 1 / math.sqrt(len(set(buckets.tolist())))
        rows.append(row)
    x, y, w, b = np.array(rows), np.array(table["block"], float), np.zeros(settings.buckets), 0.0
    for _ in range(settings.steps):
        miss = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w, b = w - settings.rate * (x.T @ miss + settings.penalty * w), b - settings.rate * miss.sum()
    return w, b


def test_url_model_equals_plain_descent():
    table = url_filter.labelled_urls().take(pa.array(range(0, 400, 9)))
    settings = url_filter.UrlModelSettings(buckets=512, steps=40)
    model = url_filter.train(table, settings)
    w, b = plain_url_model(table.to_pydict(), settings)
    assert np.allclose(model.weights, w) and model.bias == pytest.approx(b)
    assert url_filter.train(table.filter(pa.array([x == 1 for x in table["block"].to_pylist()])), settings).bias == 20.0
    assert url_filter.train(table.slice(0, 0), settings).bias == -20.0


def test_url_model_goes_by_content():
    """Names kept out of training: about one in four of each kind."""
    table = url_filter.labelled_urls()
    name = [re.sub(r"^(www|m|blog|shop)\.", "", h).split(".")[0] for h in table["host"].to_pylist()]
    held = pa.array([zlib.crc32(n.encode()) % 4 == 0 for n in name])
    model = url_filter.train(table.filter(pc.invert(held)), url_filter.UrlModelSettings())
    rest = table.filter(held)
    blocked = model.block_probability(rest["host"].combine_chunks(), rest["path"].combine_chunks()) >= 0.5
    bad = np.array(rest["block"].to_pylist()) == 1
    assert blocked[bad].mean() > 0.3 and blocked[~bad].mean() < 0.1


def test_language(spark):
    r = random.Random(2)
    parts = {"aa": ["kla", "mo", "tik", "ru"], "bb": ["sche", "ung", "ver", "lich"], "cc": ["при", "вет", "мир"]}
    word = lambda n: "".join(r.choice(parts[n]) for _ in range(3))
    rows = [(k, " ".join(word(n) for _ in range(60)), n) for k, n in enumerate(list(parts) * 40)]
    rows += [(1000, None, "aa"), (1001, "12 ... !", "bb"), (1002, "", None), (1003, rows[0][1] + " " + rows[1][1] + " " + rows[1][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id < 60"), "text", "lang", "doc_id")
    got = {r["doc_id"]: r for r in language.identify(docs, model, keep=["doc_id"]).collect()}
    assert all(got[k]["lang_pred"] == n for k, _, n in rows if k < 1000)
    assert {got[k]["lang_pred"] for k in (1000, 1001, 1002)} == {"und"}
    assert got[1003]["lang_pred"] == "bb" and 0.5 < got[1003]["score"] < 0.8
    nothing = language.train(docs.limit(0), "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in language.identify(docs, nothing, keep=["doc_id"]).collect()} == {"und"}


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(4)
    settings = language.LanguageSettings(switch=1.0)
    model = language.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), settings)
    counts = np.array([0, 5, 1, 7, 3])
    scores = r.normal(0, 1, (int(counts.sum()), 3)).astype(np.float32)
    label = model.paths(scores, np.arange(len(scores)), counts)
    import itertools

    at = 0
    for n in counts:
        own = scores[at : at + n]
        value = lambda p: sum(own[k, x] for k, x in enumerate(p)) - sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=int(n)), key=value) if n else ()
        assert value(tuple(label[at : at + n])) == pytest.approx(value(best), abs=1e-4)
        at += n


def test_lattice_equals_plain_recursion(spark, docs, rows):
    from pyspark.sql import functions as F

    small = docs.where("text is null or length(text) < 20000")
    kept = [r for r in rows if len(r[1] or "") < 20_000]
    got = lattice.score_texts(small, VOCABULARY, F.col("doc_id") % 3 > 0, keep=["doc_id", "text"]).collect()
    tokens = lambda t: words(low(t)) + [""]
    seen = Counter(w for i, t, *_ in kept if i is not None and i % 3 > 0 for w in tokens(t))
    total, distinct = sum(seen.values()), len(seen)
    assert len(got) == len(kept)
    for r in got:
        w = tokens(r["text"])
        base = sum(math.log10((seen[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(seen[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert lattice.score_texts(docs.limit(0), VOCABULARY, F.lit(True), keep=["doc_id"]).count() == 0


def plain_lattice(texts, trained):
    """Scores by plain forward and backward sums over every segmentation of every word."""
    from skein.llm.alignment import byte_letters

    letters = byte_letters()
    with open(VOCABULARY) as f:
        merges = json.load(f)["model"]["merges"]
    spelt = [bytes([letters[c]]) for c in sorted(letters)]
    spelt += [bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    place = {p: k for k, p in enumerate(spelt) if b" " not in p[1:]}
    share = {p: 1 / (k + 50) for p, k in place.items()}
    whole = sum(share.values())
    share = {p: x / whole for p, x in share.items()}

    def forward(w):
        alpha = [1.0] + [0.0] * len(w)
        for end in range(1, len(w) + 1):
            alpha[end] = sum(alpha[at] * share.get(w[at:end], 0.0) for at in range(end))
        return alpha

    spaced = [[(" " + x).encode() for x in words(low(t))] for t in texts]
    counts = Counter(w for ws, t in zip(spaced, trained) if t for w in ws)
    for _ in range(2):
        expected = {p: 1000.0 * x for p, x in share.items()}
        for w, n in counts.items():
            alpha, beta = forward(w), [0.0] * len(w) + [1.0]
            for at in range(len(w) - 1, -1, -1):
                beta[at] = sum(share.get(w[at:end], 0.0) * beta[end] for end in range(at + 1, len(w) + 1))
            for at in range(len(w)):
                for end in range(at + 1, len(w) + 1):
                    if w[at:end] in share:
                        expected[w[at:end]] += n * alpha[at] * share[w[at:end]] * beta[end] / alpha[-1]
        whole = sum(expected.values())
        share = {p: x / whole for p, x in expected.items()}
    ends = sum(trained) + 1.0
    share = {p: x * whole / (whole + ends) for p, x in share.items()}
    return [sum(math.log10(forward(w)[-1]) for w in ws) + math.log10(ends / (whole + ends)) for ws in spaced]


def test_lattice_scores_equal_plain_ones(spark):
    from pyspark.sql import functions as F

    texts = [prose(k, 12) for k in range(30)] + ["naïve café", None, "", "the The THE x", "the The THE x", "9 中文 '"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lattice.score_texts(rows, VOCABULARY, F.col("doc_id") % 4 > 0, keep=["doc_id"]).collect()}
    want = plain_lattice(texts, [k % 4 > 0 for k in range(len(texts))])
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_lattice_forward_sums_all_segmentations():
    held = lattice.Lattice(VOCABULARY)
    r = np.random.default_rng(0)
    scores = np.log(r.random(held.machine.n) / held.machine.n)
    from skein.llm.token_counts import byte_letters

    node_of = {}
    for text in (b" the", b" \xc3\xa9a", b" an"):
        rows = np.frombuffer(text, np.uint8)[None, :]
        pieces = defaultdict(list)
        for end, arcs in enumerate(held.arcs(rows)):
            for start, _, piece in arcs:
                pieces[start].append((end, int(piece[0])))

        def walk(at):
            return 1.0 if at == len(text) else sum(math.exp(scores[p]) * walk(end) for end, p in pieces[at])

        assert held.forward(rows, scores)[0, -1] == pytest.approx(math.log(walk(0)))
        counts = np.zeros(held.machine.n)
        held.expect(rows, np.ones(1), scores, counts)
        assert counts.sum() > 0 and len(pieces) <= len(text)
    assert len(byte_letters()) == 256 and not node_of


def test_toxicity(spark):
    r = random.Random(8)
    bad = ["vileword", "nastyone", "scumbag"]
    rows = []
    for k in range(300):
        w = prose(k, 150).split()
        if k % 4 == 0:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    rows += [(1000, None, 0), (1001, "", None), (1002, "!!", 0), (1003, "vileword " * 2000, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model, keep=["doc_id"]).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if i < 1000 and i % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert got[1003]["predicted"] == 1 and got[1000]["predicted"] == got[1001]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score_toxicity(docs, one, keep=["doc_id"]).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), toxicity.train(docs, labels.limit(0)), keep=["doc_id"]).count() == 0
