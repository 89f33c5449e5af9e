"""Drawn windows are laid out once for a lag, whatever their number; nodes and change points of a site come in one group."""

import datetime as dt

import numpy as np
import pytest

from slopewatch.operators import evaluate as ev

DAY = dt.date(2000, 1, 1)


def test_first_windows_of_days_serve_every_number_of_windows():
    ev.drawn_days.cache_clear()
    lag, days, seed = 5, 60, 7
    day, first = np.array([0, 3, 59, 60, -2, 20, 31]), np.array([0, 2, 5])
    begins = [np.arange(n) for n in (1, 4, 33, 64)]
    observed, total, reached = ev.hits_of_groups(begins, day, first, lag, days, 25, seed)
    assert ev.drawn_days.cache_info().misses == 1
    for k, b in enumerate(begins):
        draws = [[(p * 7919 + i * 104729 + seed * 31 + (p * i) % 8191 * 131) % (days - lag) for i in range(1, len(b) + 1)] for p in range(1, 26)]
        hits = [[sum(any(x <= d <= x + lag for x in at) for d in part if 0 <= d < days) for part in np.split(day, first[1:])] for at in draws]
        own = [sum(any(x <= d <= x + lag for x in b) for d in part) for part in np.split(day, first[1:])]
        assert observed[k].tolist() == own and total[k].tolist() == np.sum(hits, axis=0).tolist()
        assert reached[k].tolist() == (np.array(hits) >= own).sum(0).tolist()


def test_repeated_nodes_and_rows_without_keys(spark):
    events = spark.createDataFrame([(s, "P50", 3, DAY + dt.timedelta(days=d)) for s in (1, 2, None) for d in (4, 9)], "site_id long, threshold_level string, lag_days int, date date")
    changes = spark.createDataFrame([(1, 5, "strict", DAY + dt.timedelta(days=d)) for d in (4, 12, 13)] + [(1, 8, "strict", DAY), (1, 5, "other", DAY), (1, None, "strict", DAY), (None, 5, "strict", DAY)], "site_id long, node_index long, profile string, date date")
    nodes = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (None, 5), (3, 1)], "site_id long, node_index long")
    got = sorted((r.site_id, r.node_index, r.profile, r.observed, round(r.p_value * 11)) for r in ev.node_response(events, changes, nodes, DAY, 40, 10).collect())
    strict = next(x[4] for x in got if x[3])
    # site 2 has no nodes, site 3 no events; node 8 isn't listed
    assert got == [(1, 5, "medium", 0, 11)] * 2 + [(1, 5, "strict", 2, strict)] * 2 + [(1, 6, "medium", 0, 11), (1, 6, "strict", 0, 11)]


def test_scores_take_the_response_once(spark):
    rows = [(1, n, "P50", lag, f, 0.5 * n + k, (n + 1) / 20) for n in range(3) for lag in (3, 7) for k, f in enumerate(("strict", "medium"))]
    r = spark.createDataFrame(rows, "site_id long, node_index long, threshold_level string, lag_days int, profile string, lift double, p_value double").repartition(3)
    nodes = spark.createDataFrame([(1, n) for n in range(4)], "site_id long, node_index long")
    d = ev.susceptibility_scores(r, nodes)
    got = {x.node_index: x.rain_susceptibility_dense for x in d.collect()}
    a = [np.mean(np.log1p([0.5 * n, 0.5 * n + 1])) for n in range(3)]
    b = [-np.log10((n + 1) / 20) for n in range(3)]
    c = [2, 0, 0]  # p is below 0.1 for the first node only
    scale = lambda x: (np.array(x) - min(x)) / (max(x) - min(x))
    want = 0.45 * scale(a) + 0.35 * scale(b) + 0.2 * scale(c)
    assert [got[n] for n in range(4)] == pytest.approx([*want, 0.0])
    assert d._jdf.queryExecution().executedPlan().toString().count("lift#") > 0
    assert d._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
