"""Alignment of two tokenizers against the libraries, text by text."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skein.llm.alignment import PieceSide, align_tokens, byte_letters, common_ends

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    alphabet = [*" \n\t'abstrevmlldXY01.,!é ü中😀\u0085 ", "  ", "   ", " the", "ing", "<s>", "<0x41>", "<|endoftext|>", "----", "\0"]
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(300)]
    out += [None, "", " ", "   ", "x", "a▁b", "▁", "the end ", " both  sides  ", "</s>", "word " * 4000, "z" * 3000]
    return out + out[:20]


def plain(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_letters()
    rows, links = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        ids = a.encode(want.decode(), add_special_tokens=False).ids, b.encode(text or "")
        spelt = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], []
        for i in ids[1]:
            p = b.id_to_piece(i)
            spelt[1].append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if not text or any(b"".join(s) != want for s in spelt):
            rows.append(None)
            continue
        at = [{int(e): k for k, e in enumerate(np.cumsum([len(t) for t in s]))} for s in spelt]
        groups, i, j, mine = [], 0, 0, []
        for end in sorted(set(at[0]) & set(at[1])):
            x, y = at[0][end], at[1][end]
            groups.append(",".join(map(str, ids[0][i : x + 1])) + "|" + ",".join(map(str, ids[1][j : y + 1])))
            mine.append((ids[0][x], ids[1][y]))
            i, j = x + 1, y + 1
        links.update(mine)
        rows.append((len(ids[0]), len(ids[1]), ";".join(groups), len(groups), mine))
    best = defaultdict(int)
    for (x, y), n in links.items():
        best[y] = max(best[y], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, "", ""))
            continue
        n_a, n_b, groups, n, mine = row
        counts = [links[p] for p in mine]
        hits = sum(links[p] == best[p[1]] for p in mine)
        out.append((n_a, n_b, n, len(mine), hits, sum(counts), hashlib.sha256(groups.encode()).hexdigest(), groups))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


@pytest.mark.parametrize("held", [1 << 19, 5, 0])
def test_alignment_equals_the_libraries(spark, texts, held):
    docs = spark.createDataFrame([(k % 100, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, N_links string").repartition(4)
    got = align_tokens(docs, A, B, prefix="al_", groups=True, held_pairs=held).collect()
    want = plain(texts)
    assert any(w[0] for w in want) and not all(w[0] for w in want)
    assert Counter((r["doc_id"], r["text"], *(r["al_" + n] for n in NAMES)) for r in got) == Counter((k % 100, t, *w) for k, (t, w) in enumerate(zip(texts, want)))


def test_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, N_links string")
    with pytest.raises(ValueError, match="n_links"):
        align_tokens(docs, A, B)
    assert align_tokens(docs, A, B, keep=["doc_id"]).count() == 0


def test_units_give_the_ids_of_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=B)
    some = [t for t in texts if t and "▁" not in t]
    ids, counts = PieceSide(B).encode(pa.array([" " + t for t in some]))
    assert ids.tolist() == [i for t in some for i in library.encode(t)] and counts.tolist() == [len(library.encode(t)) for t in some]


def test_parts_do_not_change_common_ends():
    r = np.random.default_rng(2)
    a, b = (np.cumsum(r.integers(1, 5, 400)) for _ in range(2))
    whole = common_ends(a, b)
    assert [a[i] for i in whole[0]] == sorted(set(a.tolist()) & set(b.tolist())) == [b[j] for j in whole[1]]
    assert all(common_ends(a, b, part) == whole for part in (1, 7, 100))
    assert common_ends(a[:0], b[:0]) == ([], [])
