"""Queries do the whole job: levels, lags, draws, days, origins and candidates against brute force."""

import datetime as dt
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from slopewatch.operators import evaluate as ev
from slopewatch.operators import rain, samples

DAY = dt.date(2000, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_node_response_equals_brute_force_over_all_levels_and_lags(spark):
    rnd = random.Random(5)
    rain_rows = [(1, day(i), float(rnd.choice([0, 0, 1, 2, 5, 9, 20]))) for i in range(200)]
    e = rain.threshold_events(spark.createDataFrame(rain_rows, "site_id long, date date, rain_mm double"))
    cps = [(1, n, profile, rnd.randrange(200)) for n in range(3) for profile in ("strict", "medium") for _ in range(5)]
    nodes = spark.createDataFrame([(1, n) for n in range(4)], "site_id long, node_index long")
    cp = spark.createDataFrame([(s, n, f, day(d)) for s, n, f, d in cps], "site_id long, node_index long, profile string, date date")
    got = {(r.threshold_level, r.lag_days, r.profile, r.node_index): r for r in ev.node_response(e, cp, nodes, DAY, 200, 300).collect()}
    begins = defaultdict(list)
    for r in e.collect():
        begins[r.threshold_level, r.lag_days].append((r.date - DAY).days)
    assert set(begins) == {(p, g) for p in ("P50", "P75", "P90", "P95") for g in (3, 7, 15, 30)} and len(got) == 16 * 8
    for (level, lag), own in begins.items():
        draws = [[(p * 7919 + k * 104729 + 7 * 31 + (p * k) % 8191 * 131) % (200 - lag) for k in range(1, len(own) + 1)] for p in range(1, 301)]
        for n in range(4):
            for profile in ("strict", "medium"):
                days = [d for _, m, f, d in cps if (m, f) == (n, profile)]
                hits = [sum(any(b <= d <= b + lag for b in x) for d in days) for x in [own, *draws]]
                r = got[level, lag, profile, n]
                assert r.observed == hits[0] and r.baseline == pytest.approx(sum(hits[1:]) / 300)
                assert r.p_value == pytest.approx((sum(h >= hits[0] for h in hits[1:]) + 1) / 301)


def test_response_query_covers_all_levels_lags_and_draws(spark):
    from slopewatch.plans import catalog

    rows = catalog.queries()["e10_node_response"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.threshold_level, r.lag_days) for r in rows} == {(p, g) for p in ("P50", "P75", "P90", "P95") for g in (3, 7, 15, 30)}
    assert min(r.p_value for r in rows) < 1 / 21


def test_analogs_are_the_nearest_of_all_earlier_days(spark):
    rnd = random.Random(3)
    mm = [float(rnd.choice([0, 0, 0, 1, 4, 11])) for _ in range(120)]
    r = spark.createDataFrame([(1, day(i), x) for i, x in enumerate(mm)], "site_id long, date date, rain_mm double")
    origins = (40, 64, 65, 90, 119)
    o = spark.createDataFrame([(1, day(i)) for i in origins], "site_id long, origin_date date")
    got = {((x.origin_date - DAY).days, x.lead): x.forecast_rain_mm for x in samples.analog_fill(o, r).collect()}
    sums = {n: np.array([sum(mm[max(0, i - n) : i]) for i in range(120)]) for n in (3, 7, 15, 30)}
    want = {}
    for origin in origins:
        candidates = range(30, origin - 15)  # 30 days before, 15 leads that end before the origin
        if len(candidates) < 20:
            continue
        far = lambda c, o=origin: round(sum(abs(s[o] - s[c]) / s.std() for s in sums.values()) + 0.5 * (o - c) / 183.0, 9)
        best = sorted(candidates, key=lambda c: (far(c), c))[:5]
        want |= {(origin, lead): sum(mm[c + lead] for c in best) / 5 for lead in range(1, 16)}
    assert got.keys() == want.keys() == {(i, lead) for i in (65, 90, 119) for lead in range(1, 16)}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_every_origin_without_a_forecast_is_filled(spark):
    from slopewatch.plans import catalog
    from slopewatch.plans.bindings import Tables

    sf = "/root/testdata/sf0.001"
    t = Tables(spark, sf)
    have = {(r.site_id, r.issue_date) for r in t.forecast.collect()}
    missing = {(r.site_id, r.origin_date) for r in t.samples.collect()} - have
    for name in ("m10_climatology_fill", "m11_analog_fill"):
        rows = catalog.queries()[name](spark, sf).collect()
        assert {(r.site_id, r.origin_date) for r in rows} == missing and len(rows) == 15 * len(missing)


WHOLE = ["p4_cropped_grid", "a3_site_daily_mean", "j11_strict_lookup", "c6_quantile_fallback", "w11_stages", "a14_stage_kinematics", "a10_stage_histogram", "m10_climatology_fill", "e9_threshold_events"]


@pytest.mark.parametrize("name", WHOLE)
def test_query_equals_its_sql(spark, name):
    from slopewatch.plans import catalog
    from test_queries import SF, comparable

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = catalog.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(cur.fetchall(), names)


def test_analogs_are_not_shuffled_after_they_are_found(spark):
    from slopewatch.plans import catalog

    p = catalog.queries()["m11_analog_fill"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before, found, _ = p.partition("FlatMapCoGroupsInPandas")
    assert found and "Exchange" not in before and "Join" not in before


def test_days_without_known_rain_are_left_out_of_what_followed(spark):
    days = [day(i) for i in range(120)]
    rain = [(7, d, None if i in (40, 60) else float(i % 6)) for i, d in enumerate(days)]
    r = spark.createDataFrame(rain, "site_id long, date date, rain_mm double")
    o = spark.createDataFrame([(7, days[119])], "site_id long, origin_date date")
    got = samples.analog_fill(o, r, k=200).collect()  # more than there are candidates: all of them count
    mean = lambda lead: [rain[c + lead][2] for c in range(30, 104) if rain[c + lead][2] is not None]
    assert {x.lead: x.forecast_rain_mm for x in got} == {lead: pytest.approx(sum(mean(lead)) / len(mean(lead))) for lead in range(1, 16)}


def test_climatology_makes_leads_rows_after_all_joins(spark):
    from slopewatch.plans import catalog

    p = catalog.queries()["m10_climatology_fill"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before, found, _ = p.partition("Generate explode(transform(")
    assert found and "Join" not in before


def test_mean_of_last_days_equals_a_plain_window(spark):
    values = [None if i % 11 == 3 else (i * 37 % 23) * 0.1 for i in range(130)]
    r = spark.createDataFrame([(7, day(i), x) for i, x in enumerate(values)], "site_id long, date date, rain_mm double")
    got = {x.date: x.m90 for x in samples.last_days(r, 90).collect()}
    known = {day(i): [x for x in values[max(0, i - 90) : i] if x is not None] for i in range(130)}
    assert got == {d: pytest.approx(sum(v) / len(v)) if v else None for d, v in known.items()}
