"""The choice of columns and the machine's score against plain versions."""

import random

import numpy as np
import pytest

from slopewatch.llm import toxicity


def plain_columns(rows):
    """The columns that tell, by sets: single ones, and those of near pairs that are in three rows of label 1."""
    cols = toxicity._Columns()
    n, positive = len(rows), sum(y for _, y in rows)

    def telling(sets, least, wanted=None):
        count = {}
        for s, (_, y) in zip(sets, rows, strict=True):
            for t in s:
                a, b = count.get(t, (0, 0))
                count[t] = a + 1, b + y
        out = set()
        for t, (k, p) in count.items():
            e = k * positive / n
            spread = e * (1 - positive / n) * (n - k + 1) / n
            if k >= toxicity.LEAST_ROWS and (p - e) ** 2 / spread >= least and (wanted is None or p >= toxicity.LEAST_ROWS):
                out.add(t)
        return out

    numbers = [[cols[w] for w in toxicity.words_of(t)] for t, _ in rows]
    singles = telling([set(c) for c in numbers], toxicity.SINGLE_CHI)
    near = [{(min(a, b), max(a, b)) for i, a in enumerate(c) for b in c[i + 1 : i + 1 + toxicity.NEAR] if a != b} for c in numbers]
    return singles | {t for pair in telling(near, toxicity.PAIR_CHI, True) for t in pair}


@pytest.mark.parametrize("bits", [26, 5])  # a filter of 32 bits lets all pairs pass
def test_columns_equal_a_plain_choice(spark, monkeypatch, bits):
    monkeypatch.setattr(toxicity, "FILTER_BITS", bits)
    rnd = random.Random(3)
    words = [f"v{k}" for k in range(40)]
    rows = []
    for k in range(600):
        y = int(k % 5 == 0)
        w = [rnd.choice(words) for _ in range(rnd.randrange(3, 30))]
        if y and k % 2 == 0:
            w[1:1] = ["you", rnd.choice(words), "qq1"]
        elif k % 7 == 0:
            w += ["you"] + ["x"] * 6 + ["qq1"]
        rows.append((" ".join(w), y))
    train = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, label int")
    counts = toxicity._lists(train, toxicity.terms_of).select("label", toxicity.F.explode("terms").alias("term")).groupBy("term").agg(toxicity.F.count("*").alias("n"), toxicity.F.sum("label").alias("p"))
    positive = sum(y for _, y in rows)
    got = {r.term for r in toxicity._telling(counts, 600, positive, toxicity.SINGLE_CHI).union(toxicity.telling_pairs(train, 600, positive)).collect()}
    assert got == plain_columns(rows)


def test_a_pair_in_a_thousandth_of_the_toxic_rows_is_found(spark):
    """Neither word tells by itself; together they are in 5 of 5,000 rows of label 1, and in none of the others."""
    rnd = random.Random(8)
    texts = []
    for k in range(10_000):
        y = k % 2
        w = [f"w{rnd.randrange(500)}" for _ in range(4)]
        if y and k % 2000 == 1:
            w += ["rareone", "raretwo"]
        elif k % 1000 == 500:
            w += [rnd.choice(["rareone", "raretwo"])]
        texts.append((k, " ".join(w), y))
    train = spark.createDataFrame(texts, "doc_id long, text string, label int")
    base = toxicity.PAIR_CHI
    try:
        toxicity.PAIR_CHI = 4.9  # at equal shares of both labels five rows prove this much
        found = {r.term for r in toxicity.telling_pairs(train, 10_000, 5_000).collect()}
    finally:
        toxicity.PAIR_CHI = base
    cols = toxicity._Columns()
    assert {cols[b"rareone"], cols[b"raretwo"]} <= found


def test_score_equals_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Model({10 * k: k for k in range(12)}, -0.7, rng.normal(size=12), rng.normal(size=(12, 4)))
    for size in (0, 1, 5, 12):
        terms = np.sort(rng.choice(12, size, replace=False)) * 10
        z = m.bias + sum(m.linear[t // 10] for t in terms)
        for i, a in enumerate(terms):
            for b in terms[i + 1 :]:
                z += float(m.factors[a // 10] @ m.factors[b // 10])
        assert abs(m.score(np.append(terms, 7)) - 1 / (1 + np.exp(-z))) < 1e-12
