"""Queries on evaluation, responses to rain, learned models and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.functions import common as c
from slopewatch.operators import evaluate as ev
from slopewatch.operators import learned, rain
from slopewatch.operators import panel as p
from slopewatch.plans import rain_queries as rq
from slopewatch.plans.registry import query
from slopewatch.plans.routing_queries import MODELS, WIDE, wide

_SCOPE = """sc AS MATERIALIZED (SELECT s.site_id, s.node_index, v.scope FROM (SELECT *, quantile_cont(rain_susceptibility, 0.6) FILTER (WHERE rain_susceptibility > 0) OVER (PARTITION BY site_id) AS q FROM susceptibility) s, (VALUES ('all'), ('rain_sensitive'), ('rain_top')) v(scope)
WHERE v.scope = 'all' OR (v.scope = 'rain_sensitive' AND rain_susceptibility > 0) OR (v.scope = 'rain_top' AND rain_susceptibility > 0 AND rain_susceptibility >= q))"""
_ERR = "round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg((y_pred - y_true) * (y_pred - y_true))), 6) AS rmse, count(*) AS n"


@query("p8_node_scopes", f"WITH {_SCOPE} SELECT site_id, node_index, scope FROM sc")
def _(t):
    return ev.scopes(t.susceptibility)


@query("a1_error_by_horizon", f"SELECT model, split, horizon, {_ERR} FROM predictions GROUP BY 1, 2, 3", places=10)
def _(t):
    """V6: the horizon table."""
    return ev.error_table(t.predictions, ["model", "split", "horizon"])


@query("a2_scope_metrics", f"WITH {_SCOPE} SELECT scope, model, split, {_ERR} FROM predictions p JOIN sc ON sc.site_id = p.site_id AND sc.node_index = p.node_index GROUP BY 1, 2, 3", places=10)
def _(t):
    """Errors of all scopes of nodes from one scan."""
    return ev.error_table(ev.with_scopes(t.predictions, t.susceptibility), ["scope", "model", "split"])


_V1 = f"{_SCOPE}, vm AS (SELECT scope, seed, horizon, avg(abs(y_pred - y_true)) FILTER (WHERE model = 'trend') AS m, avg(abs(y_pred - y_true)) FILTER (WHERE model = 'persistence') AS b FROM predictions p JOIN sc ON sc.site_id = p.site_id AND sc.node_index = p.node_index WHERE split = 'test' GROUP BY 1, 2, 3)"


@query("v1_fold_metrics", f"WITH {_V1} SELECT scope, seed, " + ", ".join(f"round(max(CASE WHEN horizon = {h} THEN 100 * (b - m) / greatest(b, 1e-6) END), 6) AS gain_h{h}" for h in (1, 3, 5)) + " FROM vm GROUP BY 1, 2", places=10)
def _(t):
    """Gains over persistence by scope and horizon, pivoted."""
    d = ev.with_scopes(t.predictions.where("split = 'test'"), t.susceptibility)
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    g = d.groupBy("scope", "seed", "horizon").agg(F.avg(F.when(F.col("model") == "trend", e)).alias("m"), F.avg(F.when(F.col("model") == "persistence", e)).alias("b"))
    g = g.withColumn("gain", ev.gain(F.col("b"), F.col("m")))
    return g.groupBy("scope", "seed").pivot("horizon", [1, 3, 5]).agg(F.max("gain")).toDF("scope", "seed", "gain_h1", "gain_h3", "gain_h5")


@query("v2_full_audit", f"WITH {_SCOPE} SELECT p.model, p.seed, round(avg(e) FILTER (WHERE scope = 'all'), 6) AS global_mae, round(avg(e) FILTER (WHERE scope = 'rain_sensitive'), 6) AS rain_sensitive_mae, round(avg(e) FILTER (WHERE scope = 'rain_top'), 6) AS rain_top_mae, round(avg(e) FILTER (WHERE scope = 'rain_sensitive' AND horizon = 3), 6) AS h3_rain_sensitive_mae, round(avg(e) FILTER (WHERE scope = 'rain_sensitive' AND horizon = 5), 6) AS h5_rain_sensitive_mae, count(DISTINCT p.site_id * 1000 + start) AS samples FROM (SELECT *, abs(y_pred - y_true) AS e FROM predictions WHERE split = 'test') p JOIN sc ON sc.site_id = p.site_id AND sc.node_index = p.node_index GROUP BY 1, 2", places=10)
def _(t):
    d = ev.with_scopes(t.predictions.where("split = 'test'"), t.susceptibility).withColumn("e", F.abs(F.col("y_pred") - F.col("y_true")))
    s, h = F.col("scope"), F.col("horizon")
    mean = lambda k: F.avg(F.when(k, F.col("e")))
    return d.groupBy("model", "seed").agg(
        mean(s == "all").alias("global_mae"), mean(s == "rain_sensitive").alias("rain_sensitive_mae"), mean(s == "rain_top").alias("rain_top_mae"),
        mean((s == "rain_sensitive") & (h == 3)).alias("h3_rain_sensitive_mae"), mean((s == "rain_sensitive") & (h == 5)).alias("h5_rain_sensitive_mae"), F.count_distinct(F.col("site_id") * 1000 + F.col("start")).alias("samples"),
    )


_SEG = "sg AS (SELECT site_id, start, v.segment FROM samples, (VALUES ('all'), ('official'), ('fallback'), ('late')) v(segment) WHERE v.segment = 'all' OR (v.segment = 'official' AND NOT is_fallback) OR (v.segment = 'fallback' AND is_fallback) OR (v.segment = 'late' AND start >= 60))"
_SE = f"{_SEG}, se AS (SELECT g.segment, p.model, p.site_id, p.start, avg(abs(y_pred - y_true)) AS e FROM predictions p JOIN sg g ON g.site_id = p.site_id AND g.start = p.start WHERE split = 'test' GROUP BY 1, 2, 3, 4)"


def _segments(t):
    fb = F.col("is_fallback")
    names = F.array(F.lit("all"), F.when(~fb, F.lit("official")), F.when(fb, F.lit("fallback")), F.when(F.col("start") >= 60, F.lit("late")))
    d = t.predictions.where("split = 'test'").withColumn("segment", F.explode(F.array_compact(names)))
    return d.groupBy("segment", "model", "site_id", "start").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("e"))


@query("v4_segment_errors", f"WITH {_SE} SELECT segment, model, count(*) AS samples, round(avg(e), 6) AS mae, round(stddev_samp(e), 6) AS spread FROM se GROUP BY 1, 2", places=10)
def _(t):
    """Overlapping segments from one scan."""
    return _segments(t).groupBy("segment", "model").agg(F.count("*").alias("samples"), F.avg("e").alias("mae"), F.stddev_samp("e").alias("spread"))


_DRAW = lambda b, k, n, seed=7: f"((({b} * 7919 + {k} * 104729 + {seed} * 31 + ({b} * {k}) % 8191 * 131) % {n}) + {n}) % {n}"


@query("a18_bootstrap_by_site", f"""WITH {_SE}, nu AS MATERIALIZED (SELECT segment, model, site_id, e, row_number() OVER (PARTITION BY segment, model, site_id ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY segment, model, site_id) AS n FROM se),
gs AS (SELECT segment, model, site_id, n, avg(e) AS mean FROM nu GROUP BY 1, 2, 3, 4), pk AS (SELECT g.segment, g.model, g.site_id, b.range AS b, {_DRAW('b.range', 'k.range', 'g.n')} AS i FROM gs g, range(100) b, range(100) k WHERE k.range < g.n AND g.n >= 5),
ms AS (SELECT p.segment, p.model, p.site_id, p.b, avg(e) AS m FROM pk p JOIN nu ON nu.segment = p.segment AND nu.model = p.model AND nu.site_id = p.site_id AND nu.i = p.i GROUP BY 1, 2, 3, 4), iv AS (SELECT segment, model, site_id, quantile_cont(m, 0.05) AS lo, quantile_cont(m, 0.95) AS hi FROM ms GROUP BY 1, 2, 3)
SELECT g.segment, g.model, g.site_id, g.n, round(mean, 6) AS mean, round(coalesce(lo, mean), 6) AS lo, round(coalesce(hi, mean), 6) AS hi FROM gs g LEFT JOIN iv ON iv.segment = g.segment AND iv.model = g.model AND iv.site_id = g.site_id""", places=10)
def _(t):
    """V3: sample means of each segment, model and site with a 90 % interval."""
    return ev.bootstrap_mean(_segments(t), ["segment", "model", "site_id"], "e", ["start"])


@query("a20_regression_scores", "SELECT model, horizon, round(avg((y_pred - y_true) * (y_pred - y_true)), 6) AS mse, round(avg(CASE WHEN abs(y_true) > 0.1 THEN abs(y_pred - y_true) / abs(y_true) END), 6) AS masked_mape, round(avg(CASE WHEN abs(y_true) + abs(y_pred) > 1e-9 THEN 2 * abs(y_pred - y_true) / (abs(y_true) + abs(y_pred)) END), 6) AS smape, round(1 - var_pop(y_pred - y_true) / var_pop(y_true), 6) AS explained_variance, round(1 - avg((y_pred - y_true) * (y_pred - y_true)) / var_pop(y_true), 6) AS r2, round(corr(y_true, y_pred), 6) AS pearson FROM predictions GROUP BY 1, 2")
def _(t):
    return ev.regression_scores(t.predictions, ["model", "horizon"])


@query("a22_node_fit", "SELECT site_id, node_index, model, round(CASE WHEN var_pop(y_true) > 1e-9 THEN 1 - avg((y_pred - y_true) * (y_pred - y_true)) / var_pop(y_true) END, 5) AS r2 FROM predictions WHERE horizon = 1 GROUP BY 1, 2, 3")
def _(t):
    e = F.col("y_pred") - F.col("y_true")
    g = t.predictions.where("horizon = 1").groupBy("site_id", "node_index", "model").agg(F.when(F.var_pop("y_true") > 1e-9, 1 - F.avg(e * e) / F.var_pop("y_true")).alias("r2"))
    return g.withColumn("r2", F.round("r2", 5))


@query("a21_ssim", """WITH x AS (SELECT model, site_id, start, horizon, count(*) OVER w AS n, avg(y_true) OVER w AS mx, avg(y_pred) OVER w AS my, avg(y_true * y_true) OVER w AS xx, avg(y_pred * y_pred) OVER w AS yy, avg(y_true * y_pred) OVER w AS xy FROM predictions WHERE split = 'test' WINDOW w AS (PARTITION BY model, site_id, start, horizon ORDER BY node_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT model, site_id, start, horizon, avg((2 * mx * my + 0.01) * (2 * (7.0 / 6) * (xy - mx * my) + 0.09) / ((mx * mx + my * my + 0.01) * ((7.0 / 6) * (xx - mx * mx) + (7.0 / 6) * (yy - my * my) + 0.09))) AS s FROM x WHERE n = 7 GROUP BY 1, 2, 3, 4) SELECT model, horizon, round(avg(s), 5) AS ssim FROM s GROUP BY 1, 2""")
def _(t):
    d = ev.ssim(t.predictions.where("split = 'test'"), ["model", "site_id", "start", "horizon"], "node_index", "y_true", "y_pred", span=10.0)
    return d.groupBy("model", "horizon").agg(F.round(F.avg("ssim"), 5).alias("ssim"))


@query("a23_auc_brier", """WITH x AS (SELECT site_id, CAST(rain_mm > 20 AS INT) AS y, (day(date) * 7 % 31) / 31.0 AS s FROM daily_rain), r AS (SELECT *, rank() OVER (PARTITION BY site_id ORDER BY s) + (count(*) OVER (PARTITION BY site_id, s) - 1) / 2.0 AS r FROM x)
SELECT site_id, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, round(avg((s - y) * (s - y)), 6) AS brier FROM r GROUP BY 1""")
def _(t):
    d = t.daily_rain.select("site_id", (F.col("rain_mm") > 20).cast("int").alias("y"), (F.dayofmonth("date") * 7 % 31 / 31.0).alias("s"))
    return ev.auc(d, ["site_id"], "y", "s")


@query("a29_oracle_bound", f"WITH {WIDE} SELECT split, round(avg(least(abs(persistence - y_true), abs(damped - y_true), abs(trend - y_true))), 6) AS oracle_mae FROM w GROUP BY 1", places=10)
def _(t):
    """V8: the best expert of each cell."""
    return wide(t).groupBy("split").agg(F.avg(F.least(*[F.abs(F.col(m) - F.col("y_true")) for m in MODELS])).alias("oracle_mae"))


@query("a30_equal_experts", f"WITH {WIDE} SELECT a, b, max(d) <= 0 AS same FROM (SELECT 'persistence' AS a, 'damped' AS b, abs(persistence - damped) - (1e-8 + 1e-5 * abs(damped)) AS d FROM w UNION ALL SELECT 'persistence', 'trend', abs(persistence - trend) - (1e-8 + 1e-5 * abs(trend)) FROM w UNION ALL SELECT 'damped', 'trend', abs(damped - trend) - (1e-8 + 1e-5 * abs(trend)) FROM w) GROUP BY 1, 2")
def _(t):
    return ev.near_duplicates(wide(t), MODELS)


@query("t3_best_and_worst_nodes", "WITH e AS (SELECT site_id, node_index, avg(abs(y_pred - y_true)) AS mae FROM predictions WHERE model = 'trend' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(mae, 9), node_index) AS best, row_number() OVER (PARTITION BY site_id ORDER BY round(mae, 9) DESC, node_index) AS worst FROM e) SELECT site_id, node_index, round(mae, 6) AS mae, best <= 2 AS is_best FROM r WHERE best <= 2 OR worst <= 2", places=10)
def _(t):
    e = t.predictions.where("model = 'trend'").groupBy("site_id", "node_index").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    w = p.Window.partitionBy("site_id")
    e = e.withColumn("best", F.row_number().over(w.orderBy(F.round("mae", 9), "node_index"))).withColumn("worst", F.row_number().over(w.orderBy(F.desc(F.round("mae", 9)), "node_index")))
    return e.where("best <= 2 or worst <= 2").select("site_id", "node_index", "mae", (F.col("best") <= 2).alias("is_best"))


@query("v7_horizon_growth", "SELECT site_id, node_index, round(avg(abs(y_pred - y_true)) FILTER (WHERE horizon = 5) - avg(abs(y_pred - y_true)) FILTER (WHERE horizon = 1), 6) AS growth FROM predictions WHERE model = 'damped' GROUP BY 1, 2", places=10)
def _(t):
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    return t.predictions.where("model = 'damped'").groupBy("site_id", "node_index").agg((F.avg(F.when(F.col("horizon") == 5, e)) - F.avg(F.when(F.col("horizon") == 1, e))).alias("growth"))


@query("v11_ranked_models", "WITH m AS (SELECT model, seed, avg(abs(y_pred - y_true)) AS mae FROM predictions WHERE split = 'test' GROUP BY 1, 2), b AS (SELECT seed, mae AS base FROM m WHERE model = 'persistence') SELECT model, m.seed, round(mae, 6) AS mae, round(mae - base, 6) AS delta, CAST(row_number() OVER (PARTITION BY m.seed ORDER BY round(mae, 9), model) AS INT) AS rank FROM m JOIN b ON b.seed = m.seed", places=10)
def _(t):
    """Ranks within a seed and differences from the baseline."""
    m = t.predictions.where("split = 'test'").groupBy("model", "seed").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    b = m.where("model = 'persistence'").select("seed", F.col("mae").alias("base"))
    rank = F.row_number().over(p.Window.partitionBy("seed").orderBy(F.round("mae", 9), "model"))
    return m.join(b, "seed").select("model", "seed", "mae", (F.col("mae") - F.col("base")).alias("delta"), rank.alias("rank"))


@query("a8_mean_and_spread", "WITH m AS (SELECT model, seed, avg(abs(y_pred - y_true)) AS mae FROM predictions WHERE split = 'test' GROUP BY 1, 2) SELECT model, CAST(seed AS VARCHAR) AS seed, round(mae, 6) AS mae FROM m UNION ALL SELECT model, 'mean', round(avg(mae), 6) FROM m GROUP BY 1 UNION ALL SELECT model, 'std', round(stddev_samp(mae), 6) FROM m GROUP BY 1", places=10)
def _(t):
    m = t.predictions.where("split = 'test'").groupBy("model", "seed").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    g = m.groupBy("model").agg(F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("std")).unpivot("model", ["mean", "std"], "seed", "mae")
    return m.select("model", F.col("seed").cast("string").alias("seed"), "mae").unionByName(g)


@query("v12_sanity", "SELECT model, count(*) AS n, count(*) FILTER (WHERE isnan(y_pred)) AS bad, round(min(y_pred), 6) AS least, round(max(y_pred), 6) AS most FROM predictions GROUP BY 1")
def _(t):
    return t.predictions.groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(F.isnan("y_pred"), 1)).alias("bad"), F.min("y_pred").alias("least"), F.max("y_pred").alias("most"))


_LAG = """la AS (SELECT site_id, date, rain_mm, avg(rain_mm) OVER (PARTITION BY site_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r7 FROM daily_rain), ms AS (SELECT site_id, (year(date) - 1995) * 12 + month(date) - 1 AS t, sum(rain_mm) AS rain, max(r7) AS wet FROM la GROUP BY 1, 2),
rs AS (SELECT site_id, t, avg(q) AS change FROM panel GROUP BY 1, 2), cl AS (SELECT m.site_id, l.lag, r.t, m.rain AS x, r.change AS y FROM ms m, (VALUES (0), (1), (2), (3)) l(lag), rs r WHERE r.site_id = m.site_id AND r.t = m.t + l.lag)"""


def _lagged(t):
    m = t.daily_rain.groupBy("site_id", ((F.year("date") - 1995) * 12 + F.month("date") - 1).cast("long").alias("t")).agg(F.sum("rain_mm").alias("x"))
    r = t.panel.groupBy("site_id", "t").agg(F.avg("q").alias("y"))
    m = m.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn("t", F.col("t") + F.col("lag"))
    return m.join(r, ["site_id", "t"])


_RANK = lambda v: f"rank() OVER (PARTITION BY site_id, lag ORDER BY {v}) + (count(*) OVER (PARTITION BY site_id, lag, {v}) - 1) / 2.0"


@query("a16_permutation_p", f"""WITH {_LAG}, k AS (SELECT *, {_RANK('x')} AS rx, {_RANK('y')} AS ry FROM cl WHERE lag = 1), i AS MATERIALIZED (SELECT site_id, rx, ry, row_number() OVER (PARTITION BY site_id ORDER BY t) AS i FROM k),
pe AS (SELECT site_id, p.range AS p, i, rx, ry, row_number() OVER (PARTITION BY site_id, p.range ORDER BY {_DRAW('p.range', 'i', '65521')}, i) AS j FROM i, range(1, 51) p), rr AS (SELECT a.site_id, a.p, round(corr(a.rx, b.ry), 9) AS r FROM pe a JOIN pe b ON b.site_id = a.site_id AND b.p = a.p AND b.j = a.i GROUP BY 1, 2), ow AS (SELECT site_id, round(corr(rx, ry), 9) AS rho FROM i GROUP BY 1)
SELECT rr.site_id, round(rho, 6) AS rho, round((count(*) FILTER (WHERE abs(r) >= abs(rho)) + 1) / 51.0, 6) AS p FROM rr JOIN ow ON ow.site_id = rr.site_id GROUP BY 1, rho""")
def _(t):
    """Permutation p-values by drawn orders that any engine repeats."""
    return ev.permutation_p(_lagged(t).where("lag = 1"), ["site_id"], "x", "y", "t")


#: Drawn sets of windows for each level and lag.
PERMUTATIONS = 300

def _response(t):
    """All levels, lags and permutations. SQL is too slow for so many draws; the operator is held against brute force."""
    e = rain.threshold_events(t.daily_rain).select("site_id", "threshold_level", "lag_days", "date")
    return ev.node_response(e, t.change_points, t.nodes, "1995-01-02", 2499, PERMUTATIONS)


@query("e10_node_response")
def _(t):
    """Windows after events against drawn windows; nodes without a change point count as zero."""
    return _response(t)


@query("e11_response_summary")
def _(t):
    r = _response(t)
    return r.groupBy("lag_days", "profile").agg(F.count(F.when(F.col("p_value") < 0.05, 1)).alias("p05"), F.count(F.when(F.col("p_value") < 0.1, 1)).alias("p10"), F.max("lift").alias("max_lift"))


@query("e12_susceptibility")
def _(t):
    return ev.susceptibility_scores(_response(t), t.nodes)


@query("v14_response_matrix")
def _(t):
    return _response(t).groupBy("lag_days").pivot("profile", ["strict", "medium"]).agg(F.count(F.when(F.col("p_value") < 0.1, 1)))


@query("r14_calibrator_fit")
def _(t):
    """A logistic model of the response to events; its JSON and errors."""
    return learned.fit_calibrator(c.cut(rq.catalog(t)), ["rain_mm", "antecedent_wetness_index", "spell_rain_sum", "pre30_rain_sum"], "is_response_event")


@query("r15_gate_fit")
def _(t):
    """A gate that tells from rain and horizon-free features whether the fallback expert wins on validation samples."""
    d = wide(t).where("split = 'val'").groupBy("site_id", "start").agg(F.avg(F.abs(F.col("persistence") - F.col("y_true"))).alias("fallback"), F.avg(F.abs(F.col("trend") - F.col("y_true"))).alias("official"), F.avg(F.abs(F.col("trend") - F.col("persistence"))).alias("risk"), F.stddev_pop("persistence").alias("spread"))
    return learned.fit_gate(d.withColumn("label", (F.col("fallback") < F.col("official")).cast("double")), ["risk", "spread"])


@query("r20_residual_regressor")
def _(t):
    """A linear model of the displacement residual on lagged and neighbouring changes, weighted; errors by horizon."""
    return learned.corrected_errors(t.cells_of(p.with_near(t.panel, p.terrain_edges(t.nodes)), "near"))


@query("x1_rain_stream", "SELECT l_suppkey AS site_id, CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity), 6) AS rain_mm FROM lineitem WHERE CAST(l_shipdate AS DATE) + 4 <= (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) GROUP BY 1, 2")
def _(t):
    """Daily means from a stream of landed rain rows, appended once a day is over."""
    from slopewatch.streaming.ingest import streamed_daily_means

    return streamed_daily_means(t.spark, t.lines.select("site_id", F.col("date").cast("timestamp").alias("ts"), F.col("l_quantity").alias("rain_mm")))
