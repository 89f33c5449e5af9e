"""Decontamination, toxicity, the Jaccard join, token files and sharding against plain Python on small rows."""

import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slopewatch.llm import decontaminate, histogram_shards, id_coder, jaccard_join, token_files, toxicity
from slopewatch.llm.components import components
from slopewatch.llm.queries import op2_best_fit_packing, op7_toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = np.random.default_rng(5)
VOCABULARY = ["alpha", "Beta", "gamma", "δέλτα", "5", "éta", "theta", "iota", "kappa", "İstanbul"]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY, n))


def documents(spark, texts, ids=None, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({n: F.lit("x") for n in ("_words", "_hits", "_score", "_rid", "_key", "_at", "rid", "cls", "slot", "count")}) if extra else d


# decontamination


def plain_report(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        k = min(10, len(w))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        for j in range(len(words) - k + 1 if k else 0):
            if tuple(words[j : j + k]) in grams:
                hit |= set(range(j, j + k))
                found.add(i)
    return len(words), len(hit), found


def test_decontamination_equals_the_plain_search(spark):
    items = [(1, sentence(14)), (2, sentence(3)), (10, "one TWO three"), (3, None), (4, "..."), (5, sentence(10)), (6, sentence(10))]
    texts = [None, "", "!!!", "x one two, three y", items[0][1].upper(), sentence(40), f"a {items[4 + 1][1]} b {items[1][1]}", "word " * 3000 + items[6][1], "one two", "one two three one two three"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(documents(spark, texts), bench).collect()}
    import hashlib

    for i, t in enumerate(texts):
        n, h, found = plain_report(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, h, len(found), h > 0), (i, t)
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_decontamination_removes_documents_or_spans(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = documents(spark, ["keep One, TWO; three! me", "clean", None, "clean"], extra=True)
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [1, 2, 3]
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert spans == {0: "keep ! me", 1: "clean", 2: None, 3: "clean"}
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, empty).count() == 4
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert len(list(decontaminate.parts_of(bench, 3))) == 5  # 13 bytes
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, "lines")


# Jaccard join


def plain_components(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        o = len(sets[a] & sets[b])
        if sets[a] and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return {(ids[i], len(sets[i]), min(ids[j] for j in range(len(ids)) if group[j] == group[i])) for i in range(len(ids))}


def near_texts():
    base = [sentence(n) for n in (60, 60, 25, 9, 6)]
    out = ["", None, "   ", "a", "A ", "one two three four", "one two three  FOUR", "x " * 4000]
    for b in base:
        words = b.split()
        out.append(b)
        for _ in range(12):
            w = list(words)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = str(rng.integers(1000))
            out.append(" ".join(w))
    return out


def test_jaccard_components_equal_all_pairs(spark):
    texts = near_texts()
    ids = [int(x) for x in rng.permutation(len(texts)) * 3]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, texts, ids)).collect()}
    assert got == plain_components(texts, ids)


def test_jaccard_components_with_small_cells_and_short_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL_SHINGLES", 150)
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    texts = near_texts()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, texts)).collect()}
    assert got == plain_components(texts, list(range(len(texts))))


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b = sentence(30), sentence(31)
    docs = documents(spark, [a, a + " ", b, a, None, "", b, None], [5, 3, 7, None, 9, 10, 7, None], extra=True)
    kept = jaccard_join.near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id, r.text is None) for r in kept.collect()), key=str) == sorted([(False, 3, False), (False, 7, False), (False, 9, True), (False, 10, False), (True, None, True)], key=str)
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=14), min_size=2, max_size=12), st.integers(60, 95))
def test_linked_equals_all_pairs(sets, percent):
    sets = sorted(sets, key=len)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    group = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        o = len(sets[i] & sets[j])
        if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    assert jaccard_join.linked(arrays, percent).tolist() == group


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1, max_size=60), st.integers(0, 25), st.randoms())
def test_prefixes_of_linking_sets_share_enough(a, changes, random):
    b = set(a)
    for _ in range(changes):
        b.discard(random.randrange(200)) if random.random() < 0.5 else b.add(random.randrange(200))
    o = len(a & b)
    if not b or 100 * o < 75 * (len(a) + len(b) - o):
        return
    first = [set(sorted(s)[: jaccard_join.prefix_length(len(s), 75)]) for s in (a, b)]
    assert len(first[0] & first[1]) >= jaccard_join.least_common(min(len(a), len(b)), 75)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)] + [(160, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# sharding


def test_shards_are_even_whole_and_gapless(spark):
    texts = [sentence(int(n)) for n in rng.integers(0, 40, 400)] + ["same text of a group"] * 300 + [None, ""]
    ids = list(range(len(texts)))
    got = histogram_shards.report(documents(spark, texts, ids), 5).toPandas()
    size = np.array([len((t or "").encode()) + 8 for t in texts])
    got = got.sort_values("doc_id")
    assert got["size"].tolist() == size.tolist() and got.text_crc32.tolist() == [zlib.crc32((t or "").encode()) for t in texts]
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 5 and sums.max() - sums.min() <= 2 * size.max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert histogram_shards.report(documents(spark, texts).limit(0), 5).count() == 0


def test_identical_rows_stay_together_and_nothing_is_lost(spark):
    d = documents(spark, ["same"] * 50 + [None] * 10 + ["other"], [1] * 50 + [None] * 10 + [2], extra=True)
    out = histogram_shards.histogram_shards(d, 3).toPandas()
    assert len(out) == 61 and out[out.text == "same"].shard.nunique() == 1 and set(d.columns) < set(out.columns)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


# token files


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=700))
def test_ids_round_trip(ids):
    assert id_coder.decode(id_coder.encode(np.array(ids, np.int64))).tolist() == ids


def test_repeated_ids_are_compressed_and_damage_is_noticed():
    ids = np.tile(np.arange(50) * 900, 400)
    data = id_coder.encode(ids)
    assert len(data) < len(ids) and (id_coder.decode(data) == ids).all()
    for bad in (data[:10], data[:-4], b"none" + data[4:], data[:-40] + bytes([data[-40] ^ 1]) + data[-39:]):
        with pytest.raises(ValueError):
            id_coder.decode(bad)


def test_token_files_are_read_back_in_order(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SEGMENT", 50)
    path = P.path("word_bpe_49k.json")
    texts = [sentence(int(n)) for n in rng.integers(0, 60, 40)] + [None, "", "a\tb\u00a0c  d\n\ne", "<|endoftext|>x don't", "e\u0301 \u0301a", "ΑΣ Σ", "word " * 5000]
    ids = [int(x) for x in rng.permutation(len(texts)) - 5]
    got = token_files.report(documents(spark, texts, ids), path).orderBy("doc_id").collect()
    tok, start = Tokenizer.from_file(path), 0
    for r, (i, t) in zip(got, sorted(zip(ids, texts, strict=True)), strict=True):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert token_files.report(documents(spark, texts).limit(0), path).count() == 0


def test_words_and_pieces_get_the_tokenizers_ids():
    P = pytest.importorskip("public_tokenizers")
    encoder = token_files.Encoder(P.path("word_bpe_49k.json"))
    signs = [*"abZ0'|<> \n\t,.-ÀÿÞ×÷ßÖÉéİΣςſ中\u00a0\x01\x7f\u0301", "<|startoftext|>", "'s", "'LL", "it's"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 40)))) for _ in range(2000)] + ["", " ", "\n\n"]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for part in (slice(0, None), slice(5, 6), slice(0, 0)):
        assert [x.tolist() for x in encoder.ids([t.encode() for t in texts[part]])] == [e.ids for e in want[part]]


def test_ids_beyond_the_alphabet_are_refused():
    for bad in ([-1], [5, id_coder.ALPHABET]):
        with pytest.raises(ValueError):
            id_coder.encode(np.array(bad))


@pytest.mark.parametrize("shape", ["tiled", "alike", "distinct", "frequent"])
def test_long_blocks_round_trip(shape):
    ids = {"tiled": np.tile(rng.integers(0, 65536, 777), 90), "alike": np.full(70_000, 65535), "distinct": rng.permutation(65536), "frequent": rng.zipf(1.3, 70_000) % 65536}[shape]
    data = id_coder.encode(ids)
    assert (id_coder.decode(data) == ids).all()
    assert shape != "alike" or len(data) < 9000


# toxicity


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    texts = [sentence(12) + (" you vile troll" if i % 4 == 0 else "") for i in range(600)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.report(documents(spark, texts), labels).toPandas().set_index("doc_id")
    assert len(got) == 602 and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (toxicity.crc_remainder(i) == 2) for i in range(600))
    right = [got.predicted[i] == int(i % 4 == 0) for i in range(600) if got.held_out[i]]
    assert np.mean(right) > 0.97 and got.score[600] == got.score[601]
    kept = toxicity.without_toxic(documents(spark, texts, extra=True), labels)
    assert {0, 4, 8}.isdisjoint({r.doc_id for r in kept.select("doc_id").collect()}) and "count" in kept.columns


def test_toxicity_without_labels_gives_one_score(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.report(documents(spark, ["a", None]), none).collect()
    assert {r.score for r in got} == {0.5}


def test_toxicity_held_out_accuracy_on_the_given_tables(spark):
    d = "/root/testdata/sf0.1"
    got = op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hits = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hits / got.toxic.sum() > 0.8 and hits / got.predicted.sum() > 0.8


def test_pair_weights_change_the_score():
    m = toxicity.Model({1: 0, 2: 1}, -2.0, np.zeros(2), np.array([[2.0], [2.0]]))
    assert m.score(np.array([1])) == pytest.approx(m.score(np.array([])))
    assert m.score(np.array([1, 2])) > 0.8 > m.score(np.array([2]))


def test_packing_query_packs_every_document(spark):
    d = "/root/testdata/sf0.001"
    got = op2_best_fit_packing(spark, d)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_pairs_tell_where_single_words_do_not(spark):
    def text(i):
        # each of the two words is in half of the texts of either label; only together, near each other, they tell
        words = sentence(10).split()
        kind = i % 4
        return " ".join([*words[:5], *(["qqa", "qqb"] if kind == 0 else ["qqa"] if kind == 1 else ["qqb"] if kind == 2 else []), *words[5:]])

    n = 2400
    docs = documents(spark, [text(i) for i in range(n)])
    toxic = [int(i % 4 in (0, 3)) for i in range(n)]
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    columns = toxicity._Columns()
    a, b = (int(toxicity.terms_of(w, columns)[0]) for w in ("qqa", "qqb"))
    assert a in model.column and b in model.column
    held = [i for i in range(n) if toxicity.crc_remainder(i) == 2]
    score = {r.doc_id: r._score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(score[i] >= 0.5) == toxic[i] for i in held]) > 0.9


def test_empty_documents_and_clashing_names_of_toxicity(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int").withColumn("_score", F.lit(1)).withColumn("label", F.lit(2))
    docs = documents(spark, ["a b", "a b", None]).withColumn("_score", F.lit("x")).withColumn("label", F.lit("y"))
    assert toxicity.report(docs.limit(0), labels).count() == 0 and toxicity.report(docs, labels.limit(0)).count() == 3
    assert toxicity.without_toxic(docs, labels, 1.1).count() == 3 and toxicity.report(docs.union(docs), labels).count() == 6


def test_a_benchmark_in_parts_and_items_without_an_id(spark):
    common = [sentence(30) for _ in range(6)]
    items = [(i if i % 3 else None, t) for i, t in enumerate(common)] + [(7, common[1]), (1, common[2]), (9, None), (None, "short one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [sentence(5) + " | " + c + " | " + sentence(5) for c in common] + ["short one", None, "", "no words of the benchmark"]
    docs = documents(spark, texts)
    whole = decontaminate.scan(docs, bench).orderBy("doc_id").collect()
    parts = decontaminate.scan(docs, bench, limit=100).orderBy("doc_id").collect()
    assert whole == parts and [r._hits for r in whole][:6] == [30] * 6
    assert [r._items for r in whole][:6] == [[], [1, 7], [1, 2], [], [4], [5]] and (whole[6]._hits, whole[6]._items) == (2, [])
    cleaned = decontaminate.decontaminate(documents(spark, texts, extra=True), bench, "spans")
    assert cleaned.count() == len(texts) and decontaminate.decontaminate(cleaned, bench).count() == len(texts)
