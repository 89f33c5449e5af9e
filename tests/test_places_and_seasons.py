"""Nearest nodes in cells of any size, and seasonal means by running sums, against all pairs and all days."""

import datetime as dt

import numpy as np
import pytest

from slopewatch.operators import panel, samples

rng = np.random.default_rng(12)


def plain_nearest(rows, k):
    out = set()
    for site in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == site]
        for a in own:
            d = sorted((round((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, 12), b[1]) for b in own if b[1] != a[1])
            out |= {(site, a[1], b, i + 1) for i, (_, b) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("kind", ["dense", "sparse", "clustered", "alone", "one place"])
def test_nearest_nodes_equal_all_pairs(spark, kind):
    rows = []
    for site, n in ((1, 40), (2, 7)):
        xy = {"dense": rng.random((n, 2)) * 0.02, "sparse": rng.random((n, 2)) * 3, "clustered": rng.random((n, 2)) * 0.004 + rng.integers(0, 3, (n, 1)) * 0.7, "alone": rng.random((n, 2)) * 0.003, "one place": np.zeros((n, 2))}[kind]
        if kind == "alone":
            xy[0] += 2.0
        rows += [(site, i, float(a), float(b)) for i, (a, b) in enumerate(xy)]
    rows.append((3, 0, 1.0, 1.0))
    nodes = spark.createDataFrame(rows, "site_id long, node_index long, lon double, lat double")
    assert {(r.site_id, r.src, r.dst, r["rank"]) for r in panel.nearest_nodes(nodes).collect()} == plain_nearest(rows, 4)
    assert panel.nearest_nodes(nodes.limit(0)).count() == 0


def test_seasonal_means_equal_all_earlier_days(spark):
    first = dt.date(2003, 11, 20)
    days = [first + dt.timedelta(days=int(k)) for k in np.flatnonzero(rng.random(900) < 0.8)]  # a leap day, two turns of a year
    rain = [(1, d, float(rng.integers(0, 50))) for d in days] + [(2, dt.date(2005, 5, 5), 4.0)]
    origins = [(1, first + dt.timedelta(days=k)) for k in (0, 3, 20, 41, 60, 101, 190, 390, 401, 402, 480, 770, 899)] + [(1, dt.date(2009, 1, 3)), (2, dt.date(2005, 5, 9)), (3, first)]
    r = spark.createDataFrame(rain, "site_id long, date date, rain_mm double")
    o = spark.createDataFrame(origins, "site_id long, origin_date date")
    got = {(x.site_id, x.origin_date, x.lead): x.forecast_rain_mm for x in samples.climatology_fill(o, r).collect()}
    assert len(got) == 15 * len(origins)
    for site, origin in origins:
        own = [(d, v) for s, d, v in rain if s == site]
        at = next((i for i, (d, _) in enumerate(own) if d == origin), None)
        last = [v for _, v in own[max(0, at - 90) : at]] if at else []
        for lead in range(1, 16):
            day = (origin + dt.timedelta(days=lead)).timetuple().tm_yday
            near = [v for d, v in own if d < origin and min(abs(d.timetuple().tm_yday - day), 366 - abs(d.timetuple().tm_yday - day)) <= 30]
            expected = np.mean(near) if len(near) >= 5 else np.mean(last) if last else 0.0
            assert got[site, origin, lead] == pytest.approx(expected), (site, origin, lead)
