"""Segmentation by description length, spaced shifts, the method comparison and the fitted models: brute force and known answers."""

import json
import math

import numpy as np
import pytest

from slopewatch.operators import learned, panel

rng = np.random.default_rng(31)


def plain_mdl(x, penalty=10.0, least=5, rounds=8):
    """Greedy splits of a (T, k) series, recomputed from scratch each time."""
    cost = lambda s: sum(len(s) / 2 * math.log(max(s[:, j].var(), 1e-6)) for j in range(s.shape[1]))
    cuts = []
    for _ in range(rounds):
        edges, best = [0, *sorted(cuts), len(x)], None
        for a, b in zip(edges, edges[1:], strict=False):
            for t in range(a + least, b - least + 1):
                gain = cost(x[a:b]) - cost(x[a:t]) - cost(x[t:b]) - max(0.5, penalty / 10) * x.shape[1] * math.log(len(x))
                if gain > 1e-9 and (best is None or (round(gain, 6), t) > best):
                    best = round(gain, 6), t
        if best is None:
            break
        cuts.append(best[1])
    return set(cuts)


def test_mdl_segmentation_equals_splits_from_scratch(spark):
    series = {}
    for s in range(4):
        x = rng.normal(size=(60, 2))
        for at in rng.integers(8, 52, s):
            x[at:] += rng.normal(size=2) * 6
        series[s] = x
    rows = [(s, t, float(x[t, 0]), float(x[t, 1])) for s, x in series.items() for t in range(60)]
    d = spark.createDataFrame(rows, "site_id long, t long, a double, b double")
    got = {s: set() for s in series}
    for r in panel.mdl_segmentation(d, ["site_id"], ["a", "b"], penalty=5.0).collect():
        got[r.site_id].add(r.t)
    assert got == {s: plain_mdl(x, 5.0) for s, x in series.items()} and sum(map(len, got.values())) >= 3
    assert panel.mdl_segmentation(d.where("site_id = 0"), ["site_id"], ["a"], penalty=1000.0).count() == 0


def test_spaced_shifts_equal_a_greedy_loop(spark):
    rows = [(s, t, float(rng.integers(0, 20)) if s else 5.0) for s in range(3) for t in range(40)]
    got = {s: set() for s in range(3)}
    for r in panel.spaced(spark.createDataFrame(rows, "site_id long, t long, score double"), ["site_id"], 6).collect():
        got[r.site_id].add(r.t)
    for s in range(3):
        own = [(v, t) for k, t, v in rows if k == s]
        limit, kept = np.quantile([v for v, _ in own], 0.75), []
        for v, t in sorted(own, key=lambda x: (-x[0], x[1])):
            if v >= limit and all(abs(t - k) >= 6 for k in kept):
                kept.append(t)
        assert got[s] == set(kept)


@pytest.mark.parametrize("method", ["exact", "window", "kernel", "penalised", "bottom_up"])
def test_methods_find_a_plain_step(spark, method):
    d = spark.createDataFrame([(1, t, float(t >= 25) * 10 + float(rng.normal()) * 0.01) for t in range(50)], "site_id long, t long, mean double")
    assert 25 in {r.t for r in panel.solve_series(d, ["site_id"], "mean", method, penalty=2.0).collect()}


def test_calibrator_and_gate(spark):
    x = rng.normal(size=400)
    d = spark.createDataFrame([(float(v), bool(v + rng.normal() * 0.1 > 0), float(v > 0)) for v in x], "f double, hit boolean, label double")
    r = learned.fit_calibrator(d, ["f"], "hit").first()
    m = json.loads(r.model)
    assert m["features"] == ["f"] and m["coefs"][0] > 2 and abs(m["intercept"]) < 1 and r.brier < 0.05
    one = learned.fit_calibrator(d.where("hit"), ["f"], "hit").first()
    assert json.loads(one.model)["intercept"] == pytest.approx(math.log(one[1] + 1)) and json.loads(one.model)["coefs"] == [0.0]
    gate = {g.feature: g.coefficient for g in learned.fit_gate(d.select("f", "label"), ["f"]).collect()}
    assert gate["f"] > 2 and {g.feature: g.coefficient for g in learned.fit_gate(d.select("f", "label").where("label = 1"), ["f"]).collect()} == {"intercept": 0.5, "f": 0.0}


def test_linear_residuals_learn_a_share_of_the_trend(spark):
    rows, series = [], []
    for n in (0, 1):
        series += [(1, n, t, float(t + n)) for t in range(80)]
        for start in range(60):
            a = float(rng.normal())
            rows.append((1, start, 1, n, "test" if start % 4 == 0 else "train", start % 3 == 0, 2.0 + 0.5 * a, 2.0, 2.0 + a, 2.0 - a))
    w = spark.createDataFrame(rows, "site_id long, start long, horizon long, node_index long, split string, is_fallback boolean, y_true double, persistence double, damped double, trend double")
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 0, 1.0)], "site_id long, src long, dst long, weight double")
    r = learned.residual_regressor(w, spark.createDataFrame(series, "site_id long, node_index long, t long, disp double"), edges).first()
    assert r.model_mae < 0.1 * r.base_mae
