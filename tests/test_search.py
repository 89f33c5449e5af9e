"""Lag screens and searches over parameters against loops."""

from itertools import product

import numpy as np
import pandas as pd
import pytest

from slopewatch.functions.common import drawn
from slopewatch.operators import evaluate as ev
from slopewatch.operators import screen, search

rng = np.random.default_rng(3)


def ranks(x):
    return pd.Series(x).rank().to_numpy()


def test_lag_screen_equals_loops_over_permutations(spark):
    n, names = 30, ["a", "b", "flat"]
    f = pd.DataFrame({"site_id": 1, "t": np.arange(1, n + 1), "a": rng.integers(0, 6, n).astype(float), "b": rng.normal(size=n), "flat": 1.0})
    f.loc[3, "a"] = None
    r = pd.DataFrame([(1, s, k, t, float(rng.integers(-4, 5))) for s, k in (("all", "x"), ("top", "y")) for t in range(1, n + 1)], columns=["site_id", "scope", "response", "t", "y"])
    r.loc[5, "y"] = None
    got = screen.lag_screen(spark.createDataFrame(f), names, spark.createDataFrame(r), [0, 2, 25], 40, 7).toPandas()
    x = f.fillna(0.0).set_index("t")
    seen = 0
    for (scope, response), g in r.dropna().groupby(["scope", "response"]):
        for lag in (0, 2, 25):
            g2 = g[g.t - lag >= 1].sort_values("t")
            rows = got[(got.scope == scope) & (got.lag == lag)].set_index("feature")
            if len(g2) < 8:
                assert rows.empty
                continue
            y, item = g2.y.to_numpy(), np.arange(1, len(g2) + 1)
            for name in names:
                v = x.loc[(g2.t - lag).to_list(), name].to_numpy()
                row = rows.loc[name]
                seen += 1
                assert row.n == len(g2) and row.response == response
                hi, lo = y[v >= np.quantile(v, 0.9)].mean(), y[v <= np.quantile(v, 0.5)].mean()
                assert row.delta == pytest.approx(hi - lo)
                assert pd.isna(row.lift) if lo <= 1e-9 else row.lift == pytest.approx(hi / lo)
                if name == "flat":
                    assert pd.isna(row.rho) and pd.isna(row.p)
                    continue
                own = np.corrcoef(ranks(v), ranks(y))[0, 1]
                orders = [np.lexsort((item, drawn(p, item, 7, 65521))) for p in range(1, 41)]
                reached = sum(abs(np.corrcoef(ranks(v), ranks(y)[o])[0, 1]) >= abs(own) - 1e-12 for o in orders)
                assert row.rho == pytest.approx(own) and row.p == pytest.approx((reached + 1) / 41)
    assert seen == 12


def test_screens_in_blocks_and_without_rows(spark, monkeypatch):
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    whole = screen.rank_screen(x, y, 50, 7)
    monkeypatch.setattr(screen, "BLOCK", 30)
    assert all((a == b).all() for a, b in zip(whole, screen.rank_screen(x, y, 50, 7), strict=True))
    f = spark.createDataFrame([], "site_id long, t long, a double")
    r = spark.createDataFrame([(1, "all", "x", 1, 2.0)], "site_id long, scope string, response string, t long, y double")
    assert screen.lag_screen(f, ["a"], r).count() == 0 and screen.lag_screen(f, ["a"], r.limit(0)).count() == 0


def test_motion_responses(spark):
    panel = spark.createDataFrame([(1, n, t, float(v)) for n, s in enumerate(([0, 1, 3], [0, -2, -2])) for t, v in enumerate(s)], "site_id long, node_index long, t long, disp double")
    scopes = spark.createDataFrame([(1, 0, "all"), (1, 1, "all"), (1, 1, "top")], "site_id long, node_index long, scope string")
    got = {(r.scope, r.response, r.t): r.y for r in screen.motion_responses(panel, scopes).collect()}
    assert got == {
        ("all", "abs_increment", 1): 1.5, ("all", "abs_increment", 2): 1.0, ("all", "signed_increment", 1): -0.5, ("all", "signed_increment", 2): 1.0, ("all", "abs_increment_change", 1): 0.0, ("all", "abs_increment_change", 2): -0.5,
        ("top", "abs_increment", 1): 2.0, ("top", "abs_increment", 2): 0.0, ("top", "signed_increment", 1): -2.0, ("top", "signed_increment", 2): 0.0, ("top", "abs_increment_change", 1): 0.0, ("top", "abs_increment_change", 2): -2.0,
    }


def test_density_screen_is_the_screen_at_lag_zero(spark):
    f = pd.DataFrame({"site_id": 1, "t": np.arange(12), "a": rng.normal(size=12)})
    d = pd.DataFrame({"site_id": 1, "t": np.arange(12), "density": rng.integers(0, 3, 12) / 4})
    row = screen.density_screen(spark.createDataFrame(f), ["a"], spark.createDataFrame(d), 60).first()
    assert row.n == 12 and row.rho == pytest.approx(np.corrcoef(ranks(f.a), ranks(d.density))[0, 1])


def test_rolling_search_equals_loops_over_folds(spark):
    """Gains of a fold come from the samples before its block only; samples beyond the last block fit the final gain only."""
    ks, alphas, shrinks, nodes = (2, 4), (0.5, 1.0), (0.0, 0.1, 0.5), (0, 1, 2)
    panel = pd.DataFrame([(1, n, t, float(v)) for n in nodes for t, v in enumerate(np.cumsum(rng.normal(size=40)))], columns=["site_id", "node_index", "t", "disp"])
    at = panel.set_index(["node_index", "t"]).disp
    rows = []
    for start in range(20):  # validation 5 to 15 (eleven samples, so blocks of two), test from 16 on
        split = "train" if start < 5 else "val" if start < 16 else "test"
        for n, h in product(nodes, (1, 2)):
            last = at[n, start + 4]
            rows.append((7, 1, start, split, h, n, at[n, start + 4 + h], last, last + float(rng.normal())))
    cells = pd.DataFrame(rows, columns=["seed", "site_id", "start", "split", "horizon", "node_index", "y_true", "persistence", "trend"])
    r = search.rolling_rows(spark.createDataFrame(cells), spark.createDataFrame(panel), 5, ks)
    got = search.rolling_search(r, ["seed"], 11, 5, ks, alphas, shrinks).toPandas().set_index(["k", "alpha", "shrink"])
    assert len(got) == 12
    for k, a in product(ks, alphas):
        d = cells.copy()
        d["base"] = [p + a * h * (at[n, s + 4] - at[n, s + 5 - k]) / (k - 1) for p, h, n, s in zip(d.persistence, d.horizon, d.node_index, d.start, strict=True)]

        def gain(fit):
            out = {}
            for n, g in fit.groupby("node_index"):
                m = g.trend - g.base
                out[n] = float(np.clip((m * (g.y_true - g.base)).sum() / ((m**2).sum() + 1e-6), -1.5, 1.5))
            return out

        def errors(score, g, s):
            e = score.y_true - (score.base + s * score.node_index.map(g) * (score.trend - score.base))
            return np.sqrt((e**2).mean()), e.abs().mean()

        for s in shrinks:
            folds = [errors(d[(d.start >= 7 + 2 * f) & (d.start < 9 + 2 * f)], gain(d[(d.start >= 5) & (d.start < 7 + 2 * f)]), s) for f in range(4)]
            full = gain(d[d.split == "val"])
            row = got.loc[(k, a, s)]
            assert (row.cv_rmse, row.cv_mae) == pytest.approx(tuple(np.mean(folds, axis=0)))
            assert (row.test_rmse, row.test_mae) == pytest.approx(errors(d[d.split == "test"], full, s))
            assert row.mean_gain == pytest.approx(s * np.mean(list(full.values())))


def switch_rows():
    n = 300
    w = pd.DataFrame({"seed": rng.integers(0, 2, n), "scope": rng.choice(["all", "top"], n), "is_fallback": rng.random(n) < 0.5, "y_true": rng.normal(size=n), "risk": rng.integers(0, 11, n) / 10, "wetness": rng.random(n)})
    for m in "abc":
        w[m] = rng.normal(size=n)
    w.loc[:20, "risk"] = None
    w.loc[(w.seed == 1) & (w.scope == "top"), "is_fallback"] = False  # a group without fallback rows
    return w


def test_threshold_sweep_equals_direct_evaluation(spark):
    w, cuts = switch_rows(), (0.0, 0.3, 0.95)
    got = search.hard_switches(spark.createDataFrame(w), ["seed"], list("abc"), "risk", cuts).toPandas()
    assert len(got) == 4 * 27 * 3
    for r in got.itertuples():
        g = w[(w.seed == r.seed) & (w.scope == r.scope)]
        y = np.where(~g.is_fallback, g[r.official], np.where(g.risk >= r.threshold, g[r.event], g[r.calm]))
        assert r.mae == pytest.approx(np.abs(y - g.y_true).mean())


def test_gate_grid_equals_direct_evaluation(spark):
    w, gates = switch_rows(), [(5.0, 0.0, -1.0), (900.0, 1.0, -400.0)]
    got = search.soft_switches(spark.createDataFrame(w).repartition(3), ["seed"], list("abc"), "risk", "wetness", gates).toPandas()
    assert len(got) == 4 * 27 * 2
    for r in got.itertuples():
        g = w[(w.seed == r.seed) & (w.scope == r.scope)]
        gate = 1 / (1 + np.exp(-(r.coef_prob * g.risk.fillna(0) + r.coef_wetness * g.wetness + r.bias)))
        y = np.where(~g.is_fallback, g[r.official], gate * g[r.event] + (1 - gate) * g[r.calm])
        assert r.mae == pytest.approx(np.abs(y - g.y_true).mean())


def test_nested_neighbourhoods_equal_a_search_for_each_size(spark):
    pool = pd.DataFrame({"site_id": np.repeat([1, 2], [6, 2]), "key": range(8), "f": rng.normal(size=8), "l_a": rng.random(8), "l_b": rng.random(8)})
    ask = pd.DataFrame({"site_id": [1, 1, 2], "key": [20, 21, 22], "f": rng.normal(size=3)})
    cells = pd.DataFrame([(s, k, "all", float(rng.normal()), float(rng.normal()), float(rng.normal())) for s, k in ((1, 20), (1, 21), (2, 22)) for _ in range(4)], columns=["site_id", "key", "scope", "y_true", "a", "b"])
    sizes, temps, shares = (1, 3, 5), (0.3, 0.9), (0.0, 0.5)
    gates = search.nested_gates(spark.createDataFrame(ask), spark.createDataFrame(pool), ["site_id"], ["f"], ["a", "b"], sizes, temps, shares)
    grid = search.teacher_grid(spark.createDataFrame(cells), gates, ["site_id"], ["scope"], ["a", "b"], "a", list(product(sizes, temps, shares)))
    got = grid.toPandas().set_index(["neighbours", "temperature", "share"])
    soft = lambda loss, t: np.exp(-(loss - loss.min()) / t) / np.exp(-(loss - loss.min()) / t).sum()
    assert len(got) == 12
    for k, t, s in product(sizes, temps, shares):
        e = []
        for c in cells.itertuples():
            p = pool[pool.site_id == c.site_id]
            f = float(ask[ask.key == c.key].f.iloc[0])
            sd = p.f.std(ddof=0)
            near = p.assign(d=((p.f - f) / (sd if sd >= 1e-6 else 1)).abs()).sort_values("d").head(k)
            g = (1 - s) * soft(near[["l_a", "l_b"]].mean().to_numpy(), t) + s * soft(p[["l_a", "l_b"]].mean().to_numpy(), t)
            e.append(abs(g @ [c.a, c.b] - c.y_true))
        row = got.loc[(k, t, s)]
        assert row.teacher_mae == pytest.approx(np.mean(e)) and row.baseline_mae == pytest.approx((cells.a - cells.y_true).abs().mean()) and row.n == 12
    ranked = search.ranked_settings(grid, ["neighbours", "temperature", "share"], ["gain"]).toPandas().sort_values("rank")
    assert (np.diff(ranked.gain) <= 1e-9).all() and ranked["rank"].tolist() == list(range(1, 13))


def test_scopes_of_the_screen_are_those_of_evaluation(spark):
    s = spark.createDataFrame([(1, n, v) for n, v in enumerate((0.0, 0.2, 0.4, 0.6))], "site_id long, node_index long, rain_susceptibility double")
    assert {(r.node_index, r.scope) for r in ev.scopes(s).collect()} == {*((n, "all") for n in range(4)), *((n, "rain_sensitive") for n in (1, 2, 3)), (3, "rain_top")}
