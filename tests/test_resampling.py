"""Resampled means of large groups: draws are sums over a group's numbers, never rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopewatch.operators import audit
from slopewatch.operators import evaluate as ev
from slopewatch.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(spark):
    rng = np.random.default_rng(12)
    d = [(g, "xy"[k % 2], s, k, float(rng.normal()), float(rng.normal()) if k % 3 else None) for g in (1, 2, None) for s in range(5) for k in range(8 if g else 1)]
    return spark.createDataFrame(d, "g int, h string, site_id long, start long, a double, b double")


def test_means_of_several_columns_equal_those_of_one(spark):
    d = rows(spark).repartition(5)
    got = {(r.g, r.h, r.value): r for r in ev.bootstrap_means(d, ["g", "h"], ["a", "b"], ["site_id", "start"], 40).collect()}
    for v in ("a", "b"):
        # groups without a key are joined nowhere in the other
        want = ev.bootstrap_mean(d.where(F.col(v).isNotNull()).fillna({"g": 9}), ["g", "h"], v, ["site_id", "start"], 40).collect()
        assert len(want) == sum(k[2] == v for k in got)
        for w in want:
            r = got[None if w.g == 9 else w.g, w.h, v]
            assert r.n == w.n and (r.mean, r.lo, r.hi) == pytest.approx((w.mean, w.lo, w.hi))


def test_blocks_of_draws_add_up():
    x = [np.arange(50.0) ** 2, np.arange(50.0), np.arange(4.0)]
    whole, parts = ev.resampled_means(x, 30, 7), ev.resampled_means(x, 30, 7, block=7)
    assert all(a == pytest.approx(b) for a, b in zip(whole, parts, strict=True)) and len(whole[2]) == 0


def test_audit_reads_the_cells_once_and_joins_no_draws(spark):
    p = catalog.queries()["v3_segment_audit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(0, 99" not in p
    assert p.count("Generate posexplode") == 1


def test_errors_of_columns_equal_errors_of_rows(spark):
    cells = [(s, k, h, n, 1, k == 0, float(n + h), float(n), None if n == 2 and m == "p" else float(h * h), m) for s in (1, 2) for k in (0, 1) for h in (1, 5) for n in range(3) for m in ("p",)]
    d = spark.createDataFrame(cells, "site_id long, start long, horizon long, node_index long, seed int, is_fallback boolean, y_true double, q double, p double, model string")
    scopes = spark.createDataFrame([(s, n, "all") for s in (1, 2) for n in range(3)] + [(1, 1, "rain_sensitive"), (1, 2, "rain_sensitive")], "site_id long, node_index long, scope string")
    got = {(r.site_id, r.start): r for r in audit.sample_errors(d, scopes, ["p", "q"], audit.SAMPLE, F.count("*").alias("n")).collect()}
    assert len(got) == 4 and all(r.n == 6 for r in got.values())
    r = got[1, 0]
    # p: |h * h - (n + h)| of nodes 0 and 1 (unknown at node 2); q: |n - (n + h)| = h
    assert r.global_mae == [pytest.approx((0 + 1 + 20 + 19) / 4), 3.0]
    assert r.rain_sensitive_mae == [pytest.approx((1 + 19) / 2), 3.0] and r.h5_rain_sensitive_mae == [19.0, 5.0]
    assert got[2, 1].rain_sensitive_mae == [None, None]
