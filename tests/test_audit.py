"""Audits of overlapping subsets against plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopewatch.operators import audit

rng = np.random.default_rng(21)
DAY = dt.date(2001, 1, 1)


def cells(models=("m",)):
    rows = [(s, k, h, n, k % 2, m, bool((k + s) % 3 == 0), float(rng.normal()), float(rng.normal())) for s in (1, 2) for k in range(8) for h in (1, 3, 5) for n in (0, 1, 2) for m in models]
    return pd.DataFrame(rows, columns=["site_id", "start", "horizon", "node_index", "seed", "model", "is_fallback", "y_true", "y_pred"])


SCOPES = [(s, n, "all") for s in (1, 2) for n in range(3)] + [(1, 1, "rain_sensitive"), (1, 2, "rain_sensitive"), (1, 2, "rain_top")]


def scopes(spark):
    return spark.createDataFrame(SCOPES, "site_id long, node_index long, scope string")


def test_context_takes_the_latest_event_up_to_the_origin(spark):
    samples = spark.createDataFrame([(1, k, DAY + dt.timedelta(days=d)) for k, d in enumerate((0, 10, 70, 71))] + [(2, 0, DAY)], "site_id long, start long, origin_date date")
    events = spark.createDataFrame([(1, DAY + dt.timedelta(days=10), "E1", 4, 0.75)], "site_id long, date date, event_id string, spell_days int, antecedent_wetness_index double")
    risk = spark.createDataFrame([(1, 1, 0.5)], "site_id long, start long, risk double")
    got = {(r.site_id, r.start): (r.spell_days, r.wetness, round(r.gate, 9)) for r in audit.sample_context(samples, events, risk, (2.0, 4.0, -1.0)).collect()}
    gate = lambda x: round(1 / (1 + np.exp(-x)), 9)
    assert got == {(1, 0): (0, 0.0, gate(-1)), (1, 1): (4, 0.75, gate(1 + 3 - 1)), (1, 2): (4, 0.75, gate(3 - 1)), (1, 3): (0, 0.0, gate(-1)), (2, 0): (0, 0.0, gate(-1))}


@pytest.mark.parametrize(
    "row, names",
    [
        ((False, 0.9, 0, 0.9), {"official", "event_active_3d"}),
        ((True, 0.49, 3, 0.5), {"fallback_low_prob", "event_active_3d"}),
        ((True, 0.5, 7, 0.51), {"fallback_high_prob", "event_active_7d", "delayed_response_event"}),
        ((False, 0.0, 15, 2.0), {"official", "event_active_15d", "delayed_response_event"}),
        ((False, 0.0, 16, 0.0), {"official"}),
    ],
)
def test_the_seven_segments(spark, row, names):
    d = spark.createDataFrame([row], "f boolean, g double, s int, w double")
    assert set(d.select(audit.audit_segments(*[F.col(c) for c in "fgsw"])).first()[0]) == names


def test_segment_audit_equals_means_over_samples(spark):
    d = cells()
    context = pd.DataFrame([(s, k, int(k), 0.1 * k, k / 8) for s in (1, 2) for k in range(8)], columns=["site_id", "start", "spell_days", "wetness", "gate"])
    got = audit.segment_audit(spark.createDataFrame(d), scopes(spark), spark.createDataFrame(context), 30).toPandas().set_index(["seed", "segment", "metric"])
    d["e"] = (d.y_pred - d.y_true).abs()
    sensitive = d[(d.site_id == 1) & d.node_index.isin([1, 2])]
    for metric, part in (("global_mae", d), ("rain_sensitive_mae", sensitive), ("h5_rain_sensitive_mae", sensitive[sensitive.horizon == 5])):
        means = part.groupby(["seed", "site_id", "start", "is_fallback"]).e.mean().reset_index().merge(context, on=["site_id", "start"])
        for segment, rule in (("official", ~means.is_fallback), ("fallback_high_prob", means.is_fallback & (means.gate >= 0.5)), ("event_active_7d", means.spell_days.between(4, 7)), ("delayed_response_event", means.wetness > 0.5)):
            for seed, g in means[rule].groupby("seed"):
                row = got.loc[(seed, segment, metric)]
                assert row.n == len(g) and row["mean"] == pytest.approx(g.e.mean())
                assert g.e.min() - 1e-9 <= row.lo <= row["mean"] + 1e-9 or len(g) >= 5
                assert row.lo <= row.hi and (len(g) >= 5 or row.lo == pytest.approx(row.hi))


def test_subsets_and_focus_equal_direct_means(spark):
    d = cells().drop(columns="model").assign(base=rng.normal(size=144)).rename(columns={"y_pred": "model"})
    aligned = pd.DataFrame([(s, t, float(t == 3 and s == 1), 0.0) for s in (1, 2) for t in range(12)], columns=["site_id", "t", "p", "q"])
    samples = spark.createDataFrame(d[["site_id", "start"]].drop_duplicates())
    inside = audit.event_samples(spark.createDataFrame(aligned), samples, ["p", "q"], 2)
    assert {(r.site_id, r.start) for r in inside.where("in_event").collect()} == {(1, 2), (1, 3)} and inside.count() == 16
    got = audit.subset_metrics(spark.createDataFrame(d), ["seed"], scopes(spark), inside, "model", "base").toPandas()
    named = {(s, n, c) for s, n, c in SCOPES}
    for r in got.itertuples():
        part = d[(d.seed == r.seed) & pd.Series([(s, n, r.scope) in named for s, n in zip(d.site_id, d.node_index, strict=True)], index=d.index)]
        event = (part.site_id == 1) & part.start.isin([2, 3])
        part = part[event if r.subset == "event" else ~event if r.subset == "calm" else event | True]
        part = part if r.horizon == 0 else part[part.horizon == r.horizon]
        e, b = part.model - part.y_true, part.base - part.y_true
        assert (r.n, r.samples) == (len(part), part[["site_id", "start"]].drop_duplicates().shape[0])
        assert (r.mae, r.rmse, r.base_mae) == pytest.approx((e.abs().mean(), np.sqrt((e**2).mean()), b.abs().mean()))
        assert r.mae_gain == pytest.approx(100 * (b.abs().mean() - e.abs().mean()) / b.abs().mean())
    assert len(got) == 2 * 3 * 3 * 4
    assert {r.focus for r in audit.focus_metrics(spark.createDataFrame(got)).collect()} == set(audit.FOCUS.values())


def test_stages_count_changes_up_to_the_predicted_time(spark):
    d = spark.createDataFrame([(1, 0, h, 0, "m", 0.0, float(h)) for h in (1, 2, 3)] + [(1, 0, 1, 9, "m", 0.0, 7.0)], "site_id long, start long, horizon long, node_index long, model string, y_true double, y_pred double")
    changes = spark.createDataFrame([(1, 0, 1), (1, 0, 6), (1, 0, 6)], "site_id long, node_index long, t long")
    got = {r.stage_id: (r.n, r.mae) for r in audit.stage_metrics(d, changes, 5, ["model"]).collect()}
    assert got == {0: (1, 7.0), 1: (1, 1.0), 2: (2, 2.5)}
    assert {(r.node_index, r.n, r.mean_error) for r in audit.node_map(d, ["model"]).collect()} == {(0, 3, 2.0), (9, 1, 7.0)}


def test_stability(spark):
    g = spark.createDataFrame([("a", 1, s, x) for s, x in enumerate((0.1, 0.3))] + [("a", 2, s, x) for s, x in enumerate((-0.2, 0.4))], "kind string, k int, seed int, gain double")
    rows = {r.k: r for r in audit.stability(g, ["kind", "k"], "seed", "gain").collect()}
    assert rows[1].stable and not rows[2].stable and rows[2].positive_seeds == 1 and rows[2].worst_gain == -0.2 and rows[1].mean_gain == pytest.approx(0.2)
    one = audit.stability(g, ["kind", "k"], "seed", "gain", "kind").first()
    assert (one.settings, one.stable_share) == (2, 0.5) and one.best_gain == pytest.approx(0.2)
