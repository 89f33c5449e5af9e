"""Known answers and properties of the domain's operators."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slopewatch.functions import common as c
from slopewatch.operators import evaluate as ev
from slopewatch.operators import experts, panel, rain, samples
from slopewatch.sources import sinks, tables

DAY = dt.date(2000, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def series(spark, values, site=1, node=0):
    return spark.createDataFrame([(site, node, t, float(v)) for t, v in enumerate(values)], "site_id long, node_index long, t long, q double")


def test_asof_never_returns_a_later_row_and_keeps_all_left_rows(spark):
    left = spark.createDataFrame([(1, day(d)) for d in (0, 3, 5, 9)] + [(2, day(4))], "site_id long, at date")
    right = spark.createDataFrame([(1, day(3), 1, "a"), (1, day(3), 2, "b"), (1, day(8), 3, "c"), (3, day(0), 4, "d")], "site_id long, on date, id int, v string")
    got = {(r.site_id, r["at"]): (r.asof_on, r.asof_v) for r in c.asof_last(left, right, ["site_id"], "at", "on", ["v"], ["id"]).collect()}
    assert got == {(1, day(0)): (None, None), (1, day(3)): (day(3), "b"), (1, day(5)): (day(3), "b"), (1, day(9)): (day(8), "c"), (2, day(4)): (None, None)}


def test_interpolation_fills_gaps_edges_and_empty_groups(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, float("nan")])] + [(2, 0, None)], "g long, i long, v double")
    got = {(r.g, r.i): r.v for r in c.interpolated(d, ["g"], "i", "v").collect()}
    assert [got[1, i] for i in range(6)] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0] and got[2, 0] == 0.0


def test_greedy_suppression_keeps_the_best_of_close_days(spark):
    days = spark.createDataFrame([(1, day(i), float(r)) for i, r in enumerate([0, 5, 0, 9, 0, 0, 0, 0, 0, 0, 0, 0, 7, 0, 0, 0, 0, 0, 0, 4])], "site_id long, date date, rain_mm double")
    cand = days.where("rain_mm > 3").withColumn("event_selection_score", F.col("rain_mm"))
    got = rain.select_events(cand, days, 7).orderBy("date").collect()
    assert [(r.date, r.event_id, r.spell_days, r.spell_rain_sum) for r in got] == [(day(3), "E001", 3, 14.0), (day(12), "E002", 8, 11.0)]


def test_windows_before_exclude_the_day_itself(spark):
    days = spark.createDataFrame([(1, day(i), float(i + 1)) for i in range(6)], "site_id long, date date, rain_mm double")
    got = rain.rain_background(days).orderBy("date").collect()
    assert [r.pre3_rain_sum for r in got] == [0, 1, 3, 6, 9, 12]
    assert [r.post3_rain_sum for r in got] == [9.0, 12.0, 15.0, 11.0, 0.0, 0.0]


def test_event_priors_use_earlier_events_only(spark):
    e = spark.createDataFrame([(1, f"E{i}", day(i), w, "P90_heavy", h) for i, (w, h) in enumerate([("W1", True), ("W1", False), ("W2", True), ("W1", True)])], "site_id long, event_id string, date date, wetness_level string, rain_level string, is_response_event boolean")
    got = [(r.historical_trigger_probability, r.historical_trigger_count) for r in samples.event_priors(e).orderBy("event_id").collect()]
    assert got == [(0.5, 0), (2 / 3, 1), (0.5, 2), (0.5, 2)]


def test_folds_are_disjoint_and_ordered(spark):
    s = spark.range(0, 67).select(F.lit(1).cast("long").alias("site_id"), F.col("id").alias("start"))
    rows = samples.rolling_folds(s, [45, 60], 12, 12, 12, least=(6, 4, 4)).collect()
    for fold in {r.fold for r in rows}:
        part = {p: {r.start for r in rows if r.fold == fold and r.part == p} for p in ("train", "val", "test")}
        assert max(part["train"]) < min(part["val"]) and max(part["val"]) < min(part["test"])
        assert not part["train"] & part["val"] and not part["val"] & part["test"]


def test_stratified_split_uses_every_sample_of_large_stages(spark):
    s = spark.range(0, 24).select(F.lit(1).cast("long").alias("site_id"), F.col("id").alias("start"), F.when(F.col("id") < 20, 0).otherwise(1).alias("stage"))
    rows = samples.stratified_split(s, "stage").collect()
    big = [r.part for r in rows if r.stage == 0]
    assert len(rows) == 24 and {p: big.count(p) for p in set(big)} == {"train": 14, "val": 3, "test": 3}
    assert {r.part for r in rows if r.stage == 1} == {"train"}


def test_segmentation_finds_the_steps_and_agrees_with_dynamic_programming(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, 15), rng.normal(5, 0.1, 15), rng.normal(2, 0.1, 15)])
    got = sorted(r.t for r in panel.binary_segmentation(series(spark, x), ["site_id", "node_index"], "q", 2).collect())
    assert got == [15, 30] == panel.exact_breaks(x, 2, 5) == panel.bottom_up_breaks(x, 2, 5)
    assert panel.penalised_breaks(x, 1.0, 5) == [15, 30]
    solved = panel.solve_series(series(spark, x), ["site_id", "node_index"], "q", "exact", breaks=2).collect()
    assert [r.t for r in solved] == [15, 30]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=12, max_size=24))
def test_exact_breaks_beat_every_other_single_cut(values):
    x = np.array(values, float)
    cost = lambda a: ((a - a.mean()) ** 2).sum()
    at = panel.exact_breaks(x, 1, 3)
    assert len(at) == 1
    assert cost(x[: at[0]]) + cost(x[at[0] :]) <= min(cost(x[:k]) + cost(x[k:]) for k in range(3, len(x) - 2)) + 1e-9


def test_monotone_projection_never_turns_back_and_quantile_map_keeps_the_truth(spark):
    p = spark.createDataFrame([(1, s, h, 0, "m", float(v), float(v)) for s, row in enumerate([[1, 3, 2, 5], [0, -2, -1, -3]]) for h, v in enumerate(row, 1)], "site_id long, start long, horizon long, node_index long, model string, y_pred double, y_true double")
    for start in (0, 1):
        y = [r.y_proj for r in experts.monotone_projection(p, F.lit(0.0)).where(f"start = {start}").orderBy("horizon").collect()]
        assert y == sorted(y, reverse=bool(start))
    for r in experts.quantile_map(p, F.lit(True), ["site_id"], points=7).collect():
        assert r.y_cal == pytest.approx(r.y_true)


def test_gates_add_up_and_neighbours_are_causal(spark):
    d = spark.createDataFrame([(1, k, float(k % 5), float(k * k % 7), k) for k in range(20)], "site_id long, start long, f double, g double, key long")
    n = ev.neighbours(d, d, ["site_id"], ["f", "g"], 3, causal="start")
    assert n.where("neighbour >= query").count() == 0 and n.where("query = 0").count() == 0
    for r in ev.inverse_distance(n, ["site_id"]).groupBy("query").agg(F.sum("weight").alias("w")).collect():
        assert r.w == pytest.approx(1)
    g = d.withColumn("w", ev.softmax(F.col("f"), ["site_id"], 0.5)).agg(F.sum("w")).first()[0]
    assert g == pytest.approx(1)


def test_permutation_p_is_between_its_bounds_and_auc_handles_ties(spark):
    d = spark.createDataFrame([(1, t, float(t), float(t + (t % 3))) for t in range(12)], "site_id long, t long, x double, y double")
    r = ev.permutation_p(d, ["site_id"], "x", "y", "t", 20).first()
    assert 1 / 21 <= r.p <= 1 and r.rho > 0.9
    a = spark.createDataFrame([(1, y, s) for y, s in [(0, 0.1), (0, 0.5), (1, 0.5), (1, 0.9)]], "g long, y int, s double")
    assert ev.auc(a, ["g"], "y", "s").first().auc == pytest.approx(0.875)


def test_node_response_keeps_nodes_without_change_points(spark):
    e = spark.createDataFrame([(1, "P95", 3, day(5)), (1, "P95", 3, day(6))], "site_id long, threshold_level string, lag_days int, date date")
    cp = spark.createDataFrame([(1, 0, "strict", day(7))], "site_id long, node_index long, profile string, date date")
    nodes = spark.createDataFrame([(1, 0), (1, 1)], "site_id long, node_index long")
    got = {(r.node_index, r.profile): r for r in ev.node_response(e, cp, nodes, DAY, 100).collect()}
    assert len(got) == 4 and got[0, "strict"].observed == 1 and got[1, "strict"].observed == 0
    assert all(1 / 21 <= r.p_value <= 1 for r in got.values())


def test_readers_coerce_average_and_resolve_aliases(spark, tmp_path):
    (tmp_path / "rain.csv").write_text("date,rain_mm,soil_moisture\n2000-01-01,2,0.5\n2000-01-01,4,bad\nnever,1,1\n2000-01-02,x,0.1\n")
    got = {r.date: (r.rain_mm, r.soil_moisture) for r in tables.read_daily_rain(spark, str(tmp_path / "rain.csv")).collect()}
    assert got == {DAY: (3.0, 0.5), day(1): (0.0, 0.1)}
    (tmp_path / "f.csv").write_text("issued,target_date,precip_mm\n2000-01-01,2000-01-16,7\n2000-01-01,bad,7\n")
    assert [(r.issue_date, r.forecast_rain_mm, r.source) for r in tables.read_forecast(spark, str(tmp_path / "f.csv")).collect()] == [(DAY, 7.0, "")]
    with pytest.raises(ValueError):
        tables.required(spark.range(1), ["rain_mm"])


def test_grid_is_cropped_and_ingest_skips_known_days(spark, tmp_path):
    g = spark.createDataFrame([(1, day(0), r, k, v) for r, k, v in [(0, 0, 1.0), (0, 1, -9999.0), (5, 5, 3.0)]], "site_id long, date date, row int, col int, rain_mm double")
    assert tables.site_daily_mean(tables.crop_grid(g, (0, 1), (0, 1))).first().rain_mm == 1.0
    sinks.write_grid(g, str(tmp_path / "grid"))
    assert spark.read.parquet(str(tmp_path / "grid/cells")).count() == 3
    d = spark.createDataFrame([(1, day(0), 1.0), (1, day(1), 2.0)], "site_id long, date date, rain_mm double")
    path = str(tmp_path / "days")
    tables.append_new_days(spark, d.where("rain_mm < 2"), path)
    tables.append_new_days(spark, d, path)
    assert spark.read.parquet(path).count() == 2


def test_raster_layouts_round_trip(spark):
    wide = spark.createDataFrame([(7, *[float(i) for i in range(20)])], ["id", *[f"2000-01-{i + 1:02d}" if i else "2000-01-01.1" for i in range(20)]])
    long = panel.long_panel(wide, ["id"]).orderBy("t").collect()
    assert [r.disp for r in long] == [float(i) for i in range(20)] and long[0].date == DAY
    with pytest.raises(ValueError):
        panel.long_panel(wide.select("id", "2000-01-02"), ["id"])


def test_calibrator_refuses_missing_features(spark):
    model = '{"coefs": [1.0], "intercept": 0.0, "features": ["a"]}'
    d = spark.range(1).withColumn("a", F.lit(0.0))
    assert d.select(experts.calibrator_probability(model, [F.col("a")], ["a"])).first()[0] == pytest.approx(0.5)
    with pytest.raises(Exception, match="missing"):
        d.select(experts.calibrator_probability(model, [F.col("a")], ["b"])).collect()


def test_climatology_backs_off(spark):
    r = spark.createDataFrame([(1, day(i), float(i % 4)) for i in range(500)], "site_id long, date date, rain_mm double")
    o = spark.createDataFrame([(1, day(2)), (1, day(450))], "site_id long, origin_date date")
    got = samples.climatology_fill(o, r).where("lead = 1").orderBy("origin_date").collect()
    assert got[0].forecast_rain_mm == pytest.approx(0.5) and 0 < got[1].forecast_rain_mm < 3


def test_metrics_with_differing_headers_are_gathered_by_name(spark, tmp_path):
    for folder, text in {"one": "x,y\n1,2\n", "two": "y,z\n3,4\n5,6\n", "three": "x,y\r\n7,8\r\n", "empty": ""}.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "metrics.csv").write_text(text)
    got = {tuple(r) for r in tables.gathered_metrics(spark, f"{tmp_path}/*/metrics.csv").select("experiment", "x", "y", "z").collect()}
    assert got == {("one", "1", "2", None), ("two", None, "3", "4"), ("two", None, "5", "6"), ("three", "7", "8", None)}


def test_packs_hold_every_point(spark, tmp_path):
    rows = [(s, n, t, DAY, float(s * 100 + n * 10 + t)) for s in range(2) for n in range(3) for t in range(4)]
    panel = spark.createDataFrame(rows, "site_id long, node_index long, t long, date date, disp double").withColumn("q", F.lit(1))
    tables.write_packs(panel, f"{tmp_path}/packs")
    assert sorted(tuple(r) for r in tables.read_packs(spark, f"{tmp_path}/packs").collect()) == rows


def test_graph_forms_equal_dense_matrices(spark):
    rng = np.random.default_rng(3)
    n, edges, signal, nodes = 9, [], [], []
    dense = {}
    for site in (1, 2):
        w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.4), 1)
        w[:, n - 1] = 0  # a node without links
        edges += [(site, i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]]
        nodes += [(site, i) for i in range(n)]
        x = rng.normal(size=n)
        signal += [(site, i, float(v)) for i, v in enumerate(x)]
        s = (w + w.T) / 2
        s /= s.max()
        a, d = s + np.eye(n), s.sum(axis=1)
        r = np.where(d > 0, d, np.inf) ** -0.5
        lap = np.diag((d > 0).astype(float)) - r[:, None] * s * r[None, :]
        scaled = 2 * lap / np.linalg.eigvalsh(lap).max() - np.eye(n)
        t = [x, scaled @ x]
        t.append(2 * scaled @ t[1] - t[0])
        dense[site] = np.eye(n) + a / np.sqrt(np.outer(a.sum(axis=1), a.sum(axis=1))), scaled, t
    w = panel.symmetric_scaled(spark.createDataFrame(edges, "site_id long, src long, dst long, weight double"))
    nodes = spark.createDataFrame(nodes, "site_id long, node_index long")

    def matrix(df):
        out = {s: np.zeros((n, n)) for s in dense}
        for r in df.collect():
            out[r.site_id][r.src, r.dst] = r.value
        return out

    adjacency, laplacian = matrix(panel.renormalised_adjacency(w, nodes)), panel.scaled_laplacian(w, nodes, 10)
    found = matrix(laplacian)
    got = {(r.site_id, r.node_index, r.k): r.x for r in panel.chebyshev(laplacian, spark.createDataFrame(signal, "site_id long, node_index long, x double"), 3).collect()}
    for site, (a, scaled, t) in dense.items():
        assert np.allclose(adjacency[site], a) and np.allclose(found[site], scaled, atol=1e-9)
        assert all(got[site, i, k] == pytest.approx(t[k][i], abs=1e-7) for i in range(n) for k in range(3))


def test_window_and_kernel_solvers_find_steps():
    from itertools import combinations

    x = np.concatenate([np.zeros(20), np.full(20, 5.0), np.full(20, 1.0)]) + np.random.default_rng(1).normal(size=60) * 0.1
    assert panel.window_breaks(x, 2, 5) == [20, 40] == panel.kernel_breaks(x, 2, 5) == panel.exact_breaks(x, 2, 5)
    y = np.random.default_rng(2).normal(size=24)
    k = np.exp(-((y[:, None] - y[None, :]) ** 2) / np.median([(a - b) ** 2 for a in y for b in y if a != b]))
    cost = lambda e: sum((b - a) - k[a:b, a:b].sum() / (b - a) for a, b in zip(e[:-1], e[1:], strict=True))
    edges = [(0, *c, 24) for c in combinations(range(1, 24), 2)]
    best = min((e for e in edges if min(np.diff(e)) >= 4), key=cost)
    assert panel.kernel_breaks(y, 2, 4) == list(best[1:-1])
    assert panel.window_breaks(np.zeros(3), 2, 5) == [] == panel.kernel_breaks(np.ones(6), 2, 5)
