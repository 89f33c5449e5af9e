"""Fill-in-the-middle, byte-level BPE and lexical search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from slopewatch.llm import byte_bpe, fill_in_middle, lexical_search

TEXTS = ["", None, "a", "one two three", "one two three", "Größe: 12\n\n\tab?", "has <P> inside", "<S", "x<" * 30, "é" * 50, "word " * 3000, "z" * 5000, "A\u0000B \x1c　c", "🙂🙂 ok"]


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# fill-in-the-middle


def plain_fim(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    text = text or ""
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_units_taken_one_by_one(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "no id here"), (5, "again"), (5, "again"), (-3, "below zero")]
    docs = table(spark, [(i, t, "clash") for i, t in rows], "doc_id long, text string, `_form` string").repartition(3)
    got = fill_in_middle.report(docs).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = sorted((str(i), *map(str, plain_fim(i, t)[:4]), sha(plain_fim(i, t)[4]), sha(t or "")) for i, t in rows)
    assert sorted(tuple(map(str, r)) for r in got) == expected
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    texts = fill_in_middle.fill_in_middle(docs)
    assert texts.columns == docs.columns
    assert sorted(r.text for r in texts.collect()) == sorted(plain_fim(i, t)[4] for i, t in rows)
    assert fill_in_middle.report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.transform(docs)


def test_units_of_long_texts_are_the_same_in_parts(monkeypatch):
    text = "ab c1 Größe " * 40 + "q" * 100 + " x"
    whole = fill_in_middle.unit_ends(text).tolist()
    assert whole == [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    for span in (1, 2, 7, 64):
        monkeypatch.setattr(fill_in_middle, "SPAN", span)
        assert fill_in_middle.unit_ends(text).tolist() == whole


# byte-level BPE


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_equals_the_library(public, name):
    tiktoken = pytest.importorskip("tiktoken")
    bpe = byte_bpe._loaded(public.path(name), public.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rnd = random.Random(11)
    tokens = list(bpe.ranks)
    for k in range(600):
        if k % 3 == 0:
            text = "".join(chr(rnd.choice([rnd.randrange(1, 127), rnd.randrange(0x250), rnd.randrange(0x4E00, 0x4F00), 0x1F600 + rnd.randrange(50)])) for _ in range(rnd.randrange(200)))
        elif k % 3 == 1:
            text = b"".join(rnd.choices(tokens, k=50)).decode("utf-8", "ignore")
        else:
            text = "".join(rnd.choices(["aaaa", "    ", "a", "ab", "ing", "tion", "\n\n", "....", "==", "0000"], k=60))
        ids = bpe.encode(text)
        assert ids.tolist() == own.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_pairs_fit_where_the_merges_leave_them(public):
    bpe = byte_bpe._loaded(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rnd, tokens = random.Random(2), list(bpe.of)
    short = [t for t in tokens if bpe.size[t] <= 3]
    for k in range(6000):
        pair = (rnd.choice((tokens, short)[k % 2]), rnd.choice((tokens, short)[k // 2 % 2]))
        assert bpe._fit(pair) == (bpe.merged(bpe.of[pair[0]] + bpe.of[pair[1]]) == list(pair))


def test_bpe_backtracks_over_ranks_that_mislead():
    """The longest first token is wrong in many of these words; every word over a small alphabet is held against the merges."""
    ranks = {bytes([b]): b for b in range(256)}
    for k, t in enumerate([b"ab", b"bc", b"cd", b"abc", b"aa", b"bcd", b"aaab", b"abcdab", b"dab", b"bcda"]):
        ranks[t] = 256 + k
    bpe = byte_bpe.ByteBpe({t: r for t, r in ranks.items() if len(t) == 1 or byte_bpe.ByteBpe(ranks, ".")._merge(t, 1) == [t]}, r"[a-d]+")
    for size in range(1, 8):
        for k in range(4**size):
            word = bytes(b"abcd"[k // 4**j % 4] for j in range(size))
            assert bpe.encode_piece(word) == bpe.merged(word), word
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe({b"a": 0}, ".")


def test_bpe_report_and_columns(spark, public, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe._loaded(path, public.PATTERN).ranks, special_tokens={})
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "one two three")]
    docs = table(spark, [(i, t, 1) for i, t in rows], "doc_id long, text string, ids_sha256 int").repartition(3)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = sorted((str(i), str(len(e)), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())) for i, t in rows for e in [own.encode_ordinary(t or "")])
    assert sorted(tuple(map(str, r)) for r in byte_bpe.report(docs, path, public.PATTERN).collect()) == expected
    assert byte_bpe.report(docs.limit(0), path, public.PATTERN).count() == 0
    kept = byte_bpe.encode(docs, path, public.PATTERN)
    assert kept.columns == [*docs.columns, "_ids"]
    with pytest.raises(ValueError):
        byte_bpe.encode(kept, path, public.PATTERN)


def test_bpe_of_long_texts_and_full_memories(public, monkeypatch):
    bpe = byte_bpe.ByteBpe(byte_bpe._loaded(public.path("byte_bpe_50k.tiktoken"), public.PATTERN).ranks, public.PATTERN)
    text = "some words, wordsome somewhere 12 tionable " * 20
    whole = bpe.encode(text).tolist()
    bpe.pieces.clear()
    bpe.fits.clear()
    bpe.pieces.limit = bpe.fits.limit = 3
    assert bpe.encode(text).tolist() == whole and len(bpe.pieces) + len(bpe.pieces.old) <= 7
    monkeypatch.setattr(byte_bpe, "LONG", 10)
    assert bpe.encode(text).tolist() == whole
    assert bpe.encode("ab" * 50_000).tolist() == bpe.encode_piece(b"ab" * 50_000)


# lexical search


def plain_search(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünder", "ZZ", "12"]
    return [(k if k % 17 else None, " ".join(rnd.choice(vocabulary[: rnd.choice([5, 20, 63])]) for _ in range(rnd.randrange(60))) + rnd.choice(["", "!", "-x"])) for k in range(n)]


@pytest.mark.parametrize("leaf, block, seed_docs", [(1, 50, 0), (4, 7, 10), (32, 8192, 20_000)])
def test_search_equals_scoring_all_documents(spark, monkeypatch, leaf, block, seed_docs):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    docs = corpus(300, 5) + [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (8, "W1 w2, w3"), (9, None), (10, ""), (11, "...")]
    items = [(1, "w1 w2 w2 w3"), (2, "ünder zz 12"), (2, "W40 w41"), (3, None), (4, "nothing known"), (None, "w5 w6"), (5, " ".join(f"w{k}" for k in range(60)))]
    d = table(spark, [(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(4)
    asked = table(spark, items, "item_id long, text string")
    for top in (3, 20, 1000):
        got = lexical_search.search(d, asked, top, seed_docs=seed_docs)
        assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, top)
    parts = lexical_search.search(d, asked, 5, limit=20, seed_docs=seed_docs)
    assert sorted(map(tuple, parts.collect()), key=str) == plain_search(docs, items, 5)


def test_search_of_empty_tables(spark):
    docs, items = table(spark, corpus(10, 1)), table(spark, [(1, "w1")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_no_ball_is_too_small_and_topics_are_skipped():
    rng = np.random.default_rng(4)
    topic = np.repeat(np.arange(40), 50)
    terms = np.concatenate([np.sort(rng.choice(30, 8, replace=False)) + 30 * t for t in topic])
    rows = lexical_search.Rows(np.arange(0, len(terms) + 1, 8), terms, rng.integers(1, 10**6, len(terms)))
    tree = lexical_search.BallTree(rows, 1200)
    scored = 0
    for _ in range(30):
        q, w = np.sort(rng.choice(30, 5, replace=False)) + 30 * rng.integers(40), rng.integers(1, 10**4, 5)
        dense = np.zeros(1200, np.int64)
        dense[q] = w
        exact = rows.sums(dense)
        bound = tree.bounds(q, w)
        for node in range(len(bound)):
            assert exact[tree.order[tree.low[node] : tree.high[node]]].max() <= bound[node]
        best = lexical_search.Best(10, 1)
        best.ids, best.nulls = np.arange(2000), np.zeros(2000, bool)
        scored += tree.search(q, w, dense, best)
        assert best.score.tolist() == sorted(exact[exact > 0].tolist(), reverse=True)[:10]
    assert scored / 30 < 0.2 * 2000
