"""Responses of the same times are screened together, and features that windows of days make are put together from short ones."""

import datetime as dt

import numpy as np
import pytest

from slopewatch.operators import rain, screen

DAY = dt.date(2001, 1, 1)


def test_screens_of_several_responses_equal_single_ones(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (30, 5)).astype(float), rng.integers(0, 9, (30, 4)).astype(float)
    x[:, 3], y[:, 2] = 1.0, 2.0  # constant
    rho, p = screen.rank_screens(x, y, 50, 7)
    monkeypatch.setattr(screen, "BLOCK", 400)  # three permutations at once
    again = screen.rank_screens(x, y, 50, 7)
    assert np.array_equal(p, again[1], equal_nan=True) and np.isnan(p[2]).all() and np.isnan(p[:, 3]).all()
    for k in range(4):
        one = screen.rank_screen(x, y[:, k], 50, 7)
        assert np.array_equal(one[0], rho[k], equal_nan=True) and np.array_equal(one[1], p[k], equal_nan=True)
        for many, single in zip(screen.contrasts(x, y), screen.contrasts(x, y[:, k]), strict=True):
            assert many[k] == pytest.approx(single)


def test_ranks_of_columns_share_ties():
    x = np.array([[3.0, 1], [1, 1], [3, 1], [2, 0], [np.nan, 1]])
    assert screen.centred_ranks(x).tolist() == [[1, 1], [-4, 1], [1, 1], [-2, -4], [4, 1]]


def test_a_combination_is_one_row_until_its_features_are_told_apart(spark):
    f = spark.createDataFrame([(1, t, float(t % 5), float(t * t % 7)) for t in range(20)], "site_id long, t long, a double, b double")
    r = spark.createDataFrame([(1, s, "y", t, float(t * 3 % 11)) for s in ("p", "q") for t in range(3 if s == "q" else 0, 20)] + [(1, None, "y", 1, 1.0), (1, "p", "z", 2, None)], "site_id long, scope string, response string, t long, y double")
    d = screen.lag_screen(f, ["a", "b"], r, [0, 2], 20)
    assert sorted((x.scope, x.lag, x.feature, x.n) for x in d.collect()) == sorted((s, lag, n, min(20 - lag, 20 if s == "p" else 17)) for s in ("p", "q") for lag in (0, 2) for n in ("a", "b"))
    assert "arrays_zip" in d._jdf.queryExecution().executedPlan().toString()


def test_features_of_days_equal_plain_windows(spark):
    mm = [None if 20 <= i < 24 or i in (0, 61) else float(i * 7 % 13) for i in range(70)]
    r = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), x) for i, x in enumerate(mm)], "site_id long, date date, rain_mm double")
    a = rain.align_rain(r, r.select("site_id", "date"))
    got = {(x.date - DAY).days: x for x in a.collect()}
    known = sorted(x for x in mm if x)
    for i in range(70):
        part = {n: [x for x in mm[max(0, i - n + 1) : i + 1] if x is not None] for n in (3, 7, 15, 30)}
        assert all(got[i][f"rain_{n}d"] == (pytest.approx(sum(v)) if v else None) for n, v in part.items())
        for n in (3, 7, 15):
            assert got[i][f"rain_event_p90_{n}d"] == float(bool(part[n]) and max(part[n]) >= np.quantile(known, 0.9))
    assert "specifiedwindowframe(RowFrame, -29" not in a._jdf.queryExecution().optimizedPlan().toString()
