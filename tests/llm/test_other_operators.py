"""Packing, URL filter, chat windows, text extraction, neighbours and the pipeline on small rows."""

import hashlib
import html
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from slopewatch.llm import ann, chat_format, html_text, packing, url_filter

# packing


def plain_pack(sizes, lengths, overhead):
    """The same rules over a plain list of bins."""
    bins, left = [], sum(sizes)
    where = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fit = [b for b in bins if b["room"] >= s]
        if fit:
            least = min(b["room"] for b in fit)
            b = max((b for b in fit if b["room"] == least), key=lambda b: b["touched"])
        else:
            b = {"n": len(bins), "room": min((c for c in lengths if c >= s), key=lambda c: ((c + overhead) / min(c, left), c)), "used": 0}
            bins.append(b)
        where[i] = b["n"], b["used"]
        b["room"] -= s
        b["used"] += s
        b["touched"] = len(where)
        left -= s
    return where, [min(c for c in lengths if c >= b["used"]) for b in bins]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_packing_equals_the_plain_rules(sizes):
    lengths = (16, 32, 64)
    where, offset, size = packing.pack(np.array(sizes), lengths, 4)
    want, final = plain_pack(sizes, lengths, 4)
    assert {i: (int(w), int(o)) for i, (w, o) in enumerate(zip(where, offset, strict=True))} == want and size.tolist() == final


def test_pack_documents_is_whole_and_within_lengths(spark):
    texts = ["w " * n for n in (0, 1, 5, 100, 700, 3000)] + [None, "", "same", "same"]
    d = spark.createDataFrame(list(zip([1, 2, 3, 4, 5, 6, 7, None, 9, 9], texts, strict=True)), "doc_id long, text string").withColumn("copy", F.lit("clash"))
    got = packing.pack_documents(d, (64, 256, 512), 8, group=4).toPandas()
    assert got.n_tokens.sum() == sum(len((t or "").split()) + 1 for t in texts)
    for _, g in got.groupby("bin_id"):
        g = g.sort_values("bin_offset")
        assert g.bin_offset.tolist() == [0, *g.n_tokens.cumsum().tolist()[:-1]] and g.n_tokens.sum() <= g.bin_length.iloc[0]
        assert g.bin_length.iloc[0] == min(c for c in (64, 256, 512) if c >= g.n_tokens.sum())
    assert sorted(got[got.doc_id == 9]["copy"]) == [1, 2] and packing.pack_documents(d.limit(0)).count() == 0


def test_lengths_are_chosen_jointly():
    rng = np.random.default_rng(4)
    for most, n in ((64, 300), (30, 80), (16, 50)):
        sizes = rng.integers(1, most + 1, n)
        where, offset, size = packing.pack_jointly(sizes, (16, 32, 64), 4, 64)
        sets = [s for s in ((16,), (32,), (64,), (16, 32), (16, 64), (32, 64), (16, 32, 64)) if max(s) >= sizes.max()]
        totals = []
        for s in sets:  # every packing by the plain rules over a plain list of bins
            bins, left = [], int(sizes.sum())
            for x in sorted(sizes.tolist(), reverse=True):
                fit = [b for b in bins if b[0] >= x]
                if fit:
                    b = min(fit, key=lambda b: b[0])
                else:
                    b = [min((c for c in s if c >= x), key=lambda c: (packing.cost(c, 4, 64) / min(c, left), c)), 0]
                    bins.append(b)
                b[0] -= x
                b[1] += x
                left -= x
            totals.append(sum(packing.cost(min(c for c in (16, 32, 64) if c >= u), 4, 64) for _, u in bins))
        assert packing.cost(size, 4, 64).sum() == pytest.approx(min(totals))
        for b in range(len(size)):
            assert sizes[where == b].sum() <= size[b] and (np.sort(offset[where == b])[:1] == 0).all()
    # many short pieces and a few long ones: more than one length is opened
    _, _, size = packing.pack_jointly(np.concatenate([rng.integers(1, 500, 4000), np.full(9, 4000)]))
    assert len(set(size.tolist())) > 1


def test_sequences_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["the cat sat", "", None, "word " * 700, "É été don't 42", "the cat sat", "the cat sat"]
    ids = [1, 2, 3, 4, None, 1, 1]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("part", F.lit(1))
    got = defaultdict(list)
    for r in packing.sequences(d, (16, 64), 4).collect():
        assert len(r.ids) == r.bin_length and r.bin_length == min(c for c in (16, 64) if c >= sum(p.n_tokens for p in r.pieces))
        filled = 0
        for p in r.pieces:
            assert p.bin_offset == filled
            filled += p.n_tokens
            got[p.doc_id, p.copy].append((p.piece, r.ids[p.bin_offset : filled]))
        assert set(r.ids[filled:]) <= {packing.PAD}
    whole = sorted((str(k[0]), [i for _, x in sorted(v) for i in x]) for k, v in got.items())
    assert whole == sorted((str(i), [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in zip(ids, texts, strict=True))


# URL filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_url_rules_and_parts(spark):
    urls = {1: "http://A.Example.NET/en/1?q", 2: "https://x.net/de", 3: "http://b.example.com/de/", 4: "http://b.example.com/fr/", 5: None, 6: "no scheme", 7: "ftp://z.org/fr/x#t", 8: "http://evilexample.net/en/", 9: "a://b://c/d", 10: "http://h.net?x=/"}
    rows = [(i, u, None) for i, u in urls.items()]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(p, rules).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("x.net", "/de", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == ("b.example.com", "/fr/", None, "block")  # half of the host's pages are blocked
    assert got[5] == ("", "", None, "allow") == got[6] and got[7][2:] == ("org/fr/", "allow") and got[8][2:] == ("net/", "block")
    assert got[9][:2] == ("b:", "//c/d") and got[10][:3] == ("h.net", "", None)
    assert url_filter.judge(p.limit(0), rules).count() == 0


def plain_spread(seeds, edges, rounds):
    out, into = defaultdict(float), defaultdict(float)
    for (a, b), n in edges.items():
        out[a] += n
        into[b] += n
    now = dict(seeds)
    for _ in range(rounds):
        nxt = {h: list(v) for h, v in seeds.items()}
        for (a, b), n in edges.items():
            nxt.setdefault(a, [0.0, 0.0])
            nxt.setdefault(b, [0.0, 0.0])
        for (a, b), n in edges.items():
            nxt[b][0] += 0.85 * now.get(a, (0, 0))[0] * n / out[a]
            nxt[a][1] += 0.85 * now.get(b, (0, 0))[1] * n / into[b]
        now = {h: tuple(v) for h, v in nxt.items()}
    return now


def test_trust_and_distrust_spread_over_links(spark):
    seeds = {"good": (1.0, 0.0), "bad": (0.0, 1.0), "x": (0.0, 0.0)}
    edges = {("good", "a"): 2, ("good", "x"): 1, ("a", "good"): 1, ("farm", "bad"): 5, ("farm2", "farm"): 1, ("a", "farm"): 1}
    s = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double")
    e = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread(s, e).collect()}
    want = plain_spread(seeds, edges, url_filter.ROUNDS)
    assert got.keys() == want.keys()
    for h, v in want.items():
        assert got[h] == pytest.approx(v)


def test_pages_that_link_to_blocked_hosts_are_blocked(spark):
    rows = [(1, "http://farm.com/a", '<a href="http://bad.net/x">b</a><A HREF=\'//BAD.net/y\'>'), (2, "http://bad.net/x", ""), (3, "http://fine.com/", '<a href="/local">l</a>')]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in url_filter.judge(p, rules).collect()} == {1: "block", 2: "block", 3: "allow"}


# chat


def test_windows_are_read_back_whole(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "&lt;|im_start|>", "&amp;&", "a\nb", "", None, "x" * 9000, "<|<|", "role\n"]
    convs = {1: [("system", "be nice"), *[("user" if i % 2 else "assistant", t) for i, t in enumerate(nasty * 3)]], 2: [("assistant", "only")], 3: [(None, None)], 4: [("we\nird&<|", "t")]}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    got = {r.conv_id: r for r in chat_format.report(d, budget=60).collect()}
    for c, turns in convs.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    w = chat_format.windows(d.where("conv_id = 1"), 60).orderBy("window").collect()
    assert len(w) > 3 and sum(r.n_new for r in w) == len(convs[1])
    assert all("<|im_start|>system" in r.formatted for r in w) and all(r.n_repeated <= 3 for r in w)
    assert chat_format.report(d.limit(0)).count() == 0


def test_spans_stay_within_the_budget(spark):
    d = spark.createDataFrame([(1, i, "user", "word " * (i % 9)) for i in range(80)], "conv_id long, turn long, role string, text string")
    for r in chat_format.windows(d, 50, 0).collect():
        turns = [len(x.split("\n", 1)[1][: -len(chat_format.END)]) for x in r.formatted.split(chat_format.START)[1:]]
        tokens = [-(-n // 4) + chat_format.MARKS for n in turns]
        assert sum(tokens) <= 50 or len(tokens) == 1


def test_what_windows_repeat_is_charged_to_the_budget(spark):
    turns = [("system", "be brief"), *[("user" if i % 2 else "assistant", "é" * (i * 7 % 90)) for i in range(60)], ("user", "x" * 900), ("user", "same"), ("user", "same")]
    rows = [(c, i, r, t) for c in (1, None) for i, (r, t) in enumerate(turns)] + [(1, len(turns) - 1, "user", "same")] * 2  # repeated rows are repeated turns
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for history in (0, 2, 3):
        w = chat_format.windows(d, 400, history).collect()
        assert sum(r.n_new for r in w) == len(rows) and {r.conv_id for r in w} == {1, None}
        assert (max(r.n_repeated for r in w) == history + 1) or history > 2
        for r in w:
            assert len(r.formatted.encode()) <= 400 or r.n_new == 1 and r.n_repeated == 1
            assert r.formatted.count("<|im_start|>system") == 1


# extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy {n}</div>
<{tag}><h2>Title {n}</h2><p>First &amp; &eacute;  line {n}<br><p><b>Second <i>line</i> {n}<div class="share">Tweet</div><p class=promo-box>Follow us</p><form>Name<input></form><p>Always the same words</p>
<section class="comments"><p>I disagree {n}</p></section></{tag}><aside>Related {n}</aside><footer>&copy; x</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_is_extracted_and_template_dropped(spark):
    rows = [(n, f"http://h.com/{n}", PAGE.format(n=n, tag="article")) for n in range(12)] + [(50, "http://k.com/1", PAGE.format(n=50, tag="div")), (51, None, None), (52, "http://k.com/2", ""), (53, "x", "plain &lt;text&gt;\n\n more")]
    got = {r.page_id: r for r in html_text.report(pages(spark, rows)).collect()}
    for n in range(12):
        assert got[n].text == f"Title {n}\nFirst & é line {n}\nSecond line {n}" and got[n].n_chars == len(got[n].text)
    assert got[50].text.startswith("Title 50\nFirst & é line 50\nSecond line 50") and "Buy" not in got[50].text and "disagree" not in got[50].text
    assert got[51].text == "" == got[52].text and got[53].text == "plain <text> more"
    assert html_text.report(pages(spark, rows).limit(0)).count() == 0


def test_a_host_of_copies_keeps_its_article(spark):
    rows = [(n, f"http://h.com/{n}", "<body><nav>m</nav><article><p>The only text</article>") for n in range(20)]
    assert {r.text for r in html_text.report(pages(spark, rows)).collect()} == {"The only text"}


def test_wrappers_that_are_joined_give_the_same(spark, monkeypatch):
    rows = [(n, f"http://h.com/{n}", PAGE.format(n=n, tag="article")) for n in range(12)]
    want = {r.page_id: r.text for r in html_text.report(pages(spark, rows)).collect()}
    monkeypatch.setattr(html_text, "WRAPPER_BYTES", 0)
    assert {r.page_id: r.text for r in html_text.report(pages(spark, rows)).collect()} == want


def plain_match(a, b):
    if a.tag != b.tag:
        return 0
    x, y = a.elements(), b.elements()
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_match(x[i], y[j]))
    return m[-1][-1] + 1


TREES = st.recursive(st.sampled_from(["<p>", "<b></b>", "<i></i>"]), lambda s: st.builds(lambda t, c: f"<{t}>{''.join(c)}</{t}>", st.sampled_from(["div", "ul", "b"]), st.lists(s, max_size=4)), max_leaves=10)


@settings(max_examples=40, deadline=None)
@given(TREES, TREES)
def test_alignment_matches_as_many_nodes_as_possible(a, b):
    x, y = html_text.parse(a), html_text.parse(b)
    html_text.numbered(x)
    html_text.numbered(y)
    pairs = html_text.aligned(x, y)
    assert len(pairs) == plain_match(x, y) and all(p.tag == q.tag for p, q in pairs)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("<>/!-pdiv \"'=&;a"), max_size=80))
def test_parser_never_fails(source):
    assert html_text.main_text(source, None) is not None and html.unescape(source) is not None


BOX = "<div class='x{k}'><p>Subscribe to our letter, it is free of charge</p></div>"


def page_without_marks(n, first):
    """Two layouts of one host: the content comes first or last, with a box that all pages share inside of it."""
    rng = np.random.default_rng(n)
    words = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 9000, k))
    body = [words(30) for _ in range(int(rng.integers(2, 6)))]
    content = f"<div><h2>Title {n}</h2><p>{body[0]}</p>" + BOX.format(k=1) + "".join(f"<p>{x}</p>" for x in body[1:]) + "</div>"
    links = "<div><ul>" + "".join(f"<li><a href=/{x}>{words(2)}</a></li>" for x in range(9)) + "</ul></div>"
    source = f"<body><header>Site</header>{content}{links}" if first else f"<body>{links}<div>advert {words(3)}</div>{content}"
    return source, "\n".join([f"Title {n}", *body])


def test_content_is_found_by_alignment_without_marks(spark):
    made = [page_without_marks(n, n % 5 < 3) for n in range(60)]
    got = {r.page_id: r.text for r in html_text.report(pages(spark, [(n, f"http://h.com/{n}", s) for n, (s, _) in enumerate(made)])).collect()}
    assert all(got[n] == want for n, (_, want) in enumerate(made))
    # without other pages of its host, nothing tells that the box is template
    alone = html_text.main_text(made[0][0], None)
    assert alone != got[0] and "Subscribe" in alone and alone.replace("Subscribe to our letter, it is free of charge\n", "") == got[0]


def test_near_copies_of_one_article_keep_their_paragraphs(spark):
    same = "".join(f"<p>Paragraph {k} that all the copies share, word by word</p>" for k in range(9))
    rows = [(n, f"http://h.com/{n}", f"<body><nav>m</nav><article>{same}<p>only here {n}</p></article>") for n in range(20)]
    assert all(r.text.count("Paragraph") == 9 and r.text.endswith(f"only here {r.page_id}") for r in html_text.report(pages(spark, rows)).collect())


def test_parts_of_words_in_a_class_say_nothing():
    source = '<body><article><header class="entry-header"><h1>The title</h1></header><div class="side-effects"><p>What it does</p></div><div class="share">no</div></article>'
    assert html_text.main_text(source, None) == "The title\nWhat it does"


def test_bad_pages_take_no_longer_than_others():
    import time

    row = "<p>a</p>"
    wide = html_text.Wrapper("<body><div>" + row * 20_000 + "</div>", 2)
    began = time.process_time()
    for bad in ('<a ' + '"' * 101, '<a ' + '"' * 101 + ">x", '<a "' * 50_000, "<![CDATA[" * 50_000 + ">", "<div>" * 20_000 + "</x>" * 20_000, "<b>" * 20_000 + "<div></i>" * 20_000):
        assert html_text.main_text(bad, None) is not None
    assert html_text.main_text("<body><div>" + (row + "<ul><li>x</ul>") * 10_000 + "</div>", wide).count("a") == 10_000
    assert time.process_time() - began < 20


def test_deep_pages_do_not_fail(spark):
    rows = [(1, "http://h.com/", "<div>" * 3000 + "deep"), (2, "http://h.com/2", "<p>x")]
    assert {r.page_id: r.text for r in html_text.report(pages(spark, rows)).collect()}[1] == "deep"


# neighbours


def test_recall_on_the_given_vectors_and_exact_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(e, lambda i: i % 20 == 0).toPandas()
    p = e.toPandas().sort_values("vec_id")
    ids, x = p.vec_id.to_numpy(), np.array(p.embedding.tolist(), np.float64)
    hits = total = 0
    for q, g in got.groupby("query_id"):
        i = int(np.flatnonzero(ids == q)[0])
        s = x @ x[i]
        s[i] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        hits, total = hits + len(set(want) & set(g.vec_id)), total + 20
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, s[np.searchsorted(ids, g.vec_id)], rtol=0, atol=1e-12) and (np.diff(g.score) <= 0).all()
    assert hits / total >= 0.9


def test_invalid_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.0, -0.0]), (1, [0.5, 0.5]), (8, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = ann.search(d, lambda i: i % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(d.limit(0), lambda i: i % 20 == 0).count() == 0


def test_vectors_of_other_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0]), (3, [1.0, 2.0, 3.0]), (4, [0.2, 0.1]), (4, [0.9, 0.1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("parts", F.lit("clash"))
    got = ann.search(d, lambda i: i % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(4, 0.9), (1, 0.5)]


def test_clustered_vectors_need_few_partitions(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 16)) * 4
    v = centre[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    router = ann.learn(d)
    assert len(router.bias) > 40 and router.probes < 0.2 * len(router.bias)
    again = ann.learn(d.repartition(5))
    assert (router.weight == again.weight).all() and router.probes == again.probes


def test_copies_are_dealt_into_cells_without_loss(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_VECTORS", 40)
    monkeypatch.setattr(ann, "CELL_QUERIES", 3)
    rng = np.random.default_rng(2)
    v = [rng.normal(size=8).tolist() for _ in range(100)] + [[1.0] * 8] * 300
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(d, lambda i: i % 20 == 0, probe_share=1.0).toPandas()
    x = np.array(v)
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert g.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(400), -np.round(s, 12)))[:20].tolist()


# pipeline


def test_stages_keep_columns_and_clean_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        kept = out.count()
        assert 0 < kept <= before and out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert stage(spark, docs.limit(0), d).count() == 0
        before, docs = kept, out
    assert corpus_pipeline.run(spark, d).select("doc_id").distinct().count() == before
