"""Queries on daily rain and rain events."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.functions import common as c
from slopewatch.operators import rain
from slopewatch.plans.registry import nudge, query

_PRE = (3, 7, 15, 30, 45, 60)
_SUMS = ", ".join(
    [f"coalesce(sum(rain_mm) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) AS pre{n}_rain_sum" for n in _PRE]
    + [f"CAST(coalesce(sum(CAST(rain_mm >= 1 AS INT)) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre{n}_rainy_days" for n in _PRE]
    + [f"CAST(coalesce(sum(CAST(rain_mm >= P{p} AS INT)) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre{n}_p{p}_days" for n in (30, 60) for p in (75, 90, 95)]
    + [f"CASE WHEN count(*) OVER (PARTITION BY site_id) - row_number() OVER w >= {n - 1} THEN coalesce(sum(rain_mm) OVER (w ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING), 0) ELSE 0 END AS post{n}_rain_sum" for n in (3, 7, 15, 30)]
)
_THR = "thr AS (SELECT site_id, " + ", ".join(f"quantile_cont(rain_mm, {p / 100}) AS P{p}" for p in (50, 75, 90, 95)) + " FROM daily_rain WHERE rain_mm > 0 GROUP BY site_id)"
BACKGROUND = f"""{_THR},
bg0 AS (SELECT r.*, P50, P75, P90, P95, {_SUMS} FROM daily_rain r JOIN thr USING (site_id) WINDOW w AS (PARTITION BY site_id ORDER BY date)),
bg AS MATERIALIZED (SELECT *, {", ".join(f"max(pre{n}_rain_sum) OVER (PARTITION BY site_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS max_roll{n}_before" for n in (7, 15, 30))} FROM bg0)"""
_SCALE = lambda x, part="PARTITION BY site_id": f"greatest(0, ({x} - quantile_cont({x}, 0.25) OVER ({part})) / greatest(quantile_cont({x}, 0.75) OVER ({part}) - quantile_cont({x}, 0.25) OVER ({part}), 1e-6))"
CANDIDATES = f"""{BACKGROUND},
wet AS (SELECT site_id, quantile_cont(pre60_rain_sum, 0.8) AS w60, quantile_cont(pre30_rain_sum, 0.8) AS w30 FROM bg GROUP BY site_id),
cand0 AS (SELECT bg.* FROM bg JOIN wet USING (site_id) WHERE rain_mm >= P75 OR (rain_mm >= P50 AND (pre60_rain_sum >= w60 OR pre30_rain_sum >= w30))),
cand AS MATERIALIZED (SELECT *, rain_mm / greatest(P95, 1e-6) + 0.5 * {_SCALE("pre30_rain_sum")} + 0.5 * {_SCALE("pre60_rain_sum")} AS event_selection_score FROM cand0)"""

_ROUND = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
_BG_INT = [f"pre{n}_rainy_days" for n in _PRE] + [f"pre{n}_p{p}_days" for n in (30, 60) for p in (75, 90, 95)]
_BG_NUM = ["rain_mm", *[f"pre{n}_rain_sum" for n in _PRE], *[f"max_roll{n}_before" for n in (7, 15, 30)], *[f"post{n}_rain_sum" for n in (3, 7, 15, 30)]]


@query("j2_dense_daily_rain", "SELECT site_id, date, round(rain_mm, 6) AS rain_mm FROM daily_rain")
def _(t):
    wet = t.lines.groupBy("site_id", "date").agg(F.sum("l_quantity").alias("rain_mm"))
    return rain.dense_days(wet, "1995-01-02", "2001-11-04")


@query("a4_rain_thresholds", f"WITH {_THR} SELECT site_id, {_ROUND(['P50', 'P75', 'P90', 'P95'])} FROM thr")
def _(t):
    return rain.thresholds(t.daily_rain)


@query("e3_rain_background", f"WITH {BACKGROUND} SELECT site_id, date, {_ROUND(_BG_NUM)}, {', '.join(_BG_INT)} FROM bg")
def _(t):
    """Sums before and after each day, stacked windows."""
    return rain.rain_background(t.daily_rain).select("site_id", "date", *_BG_NUM, *_BG_INT)


@query("e4_event_candidates", f"WITH {CANDIDATES} SELECT site_id, date, {_ROUND(['rain_mm', 'pre30_rain_sum', 'pre60_rain_sum', 'event_selection_score'])} FROM cand")
def _(t):
    return rain.event_candidates(rain.rain_background(t.daily_rain)).select("site_id", "date", "rain_mm", "pre30_rain_sum", "pre60_rain_sum", "event_selection_score")


@query("t2_top_candidates", f"WITH {CANDIDATES} SELECT site_id, date, round(event_selection_score, 6) AS event_selection_score FROM cand ORDER BY round(event_selection_score, 6) DESC, site_id, date LIMIT 20")
def _(t):
    d = rain.event_candidates(rain.rain_background(t.daily_rain)).select("site_id", "date", F.round(F.col("event_selection_score") + nudge(6), 6).alias("event_selection_score"))
    return d.orderBy(F.desc("event_selection_score"), "site_id", "date").limit(20)


def _events(t, *columns):
    """The events with all columns of the background, or with those named."""
    candidates = rain.event_candidates(rain.rain_background(t.daily_rain))
    return rain.select_events(candidates.select(*columns) if columns else candidates, t.daily_rain)


_EVENTS = f"""{CANDIDATES},
ranked AS (SELECT site_id, list(date ORDER BY round(event_selection_score, 9) DESC, rain_mm DESC, date) AS ds FROM cand GROUP BY site_id),
kept AS (SELECT site_id, list_reduce(list_prepend(CAST([] AS DATE[]), list_transform(ds, lambda d: [d])), lambda a, x: CASE WHEN len(list_filter(a, lambda k: abs(date_diff('day', k, x[1])) <= 7)) > 0 THEN a ELSE a || x END) AS ks FROM ranked),
chosen AS MATERIALIZED (SELECT site_id, unnest(ks) AS date FROM kept),
spell AS (SELECT e.site_id, e.date, coalesce(min(r.date) FILTER (WHERE rain_mm > 0), min(r.date)) AS spell_start, coalesce(max(r.date) FILTER (WHERE rain_mm > 0), max(r.date)) AS spell_end,
  sum(rain_mm) AS spell_rain_sum, max(rain_mm) AS spell_peak_rain FROM chosen e JOIN daily_rain r ON r.site_id = e.site_id AND r.date BETWEEN e.date - 7 AND e.date + 7 GROUP BY 1, 2),
ev AS MATERIALIZED (SELECT c.*, spell_start, spell_end, spell_rain_sum, spell_peak_rain, date_diff('day', spell_start, spell_end) + 1 AS spell_days,
  'E' || lpad(CAST(row_number() OVER (PARTITION BY c.site_id ORDER BY c.date) AS VARCHAR), 3, '0') AS event_id FROM cand c JOIN spell USING (site_id, date))"""


@query("e5_select_events", f"WITH {_EVENTS} SELECT site_id, date, event_id, spell_start, spell_end, CAST(spell_days AS INT) AS spell_days, {_ROUND(['spell_rain_sum', 'spell_peak_rain', 'event_selection_score'])} FROM ev")
def _(t):
    """T5: greedy suppression in time, with the extents of wet spells."""
    return _events(t, "site_id", "date", "rain_mm", "event_selection_score").select("site_id", "date", "event_id", "spell_start", "spell_end", "spell_days", "spell_rain_sum", "spell_peak_rain", "event_selection_score")


_LAGS = (3, 7, 15)
_ACTIVE = "act AS (SELECT site_id, node_index FROM (SELECT *, max(rain_susceptibility) OVER (PARTITION BY site_id) AS m, quantile_cont(rain_susceptibility_dense, 0.75) OVER (PARTITION BY site_id) AS q FROM susceptibility) WHERE CASE WHEN m > 0 THEN rain_susceptibility > 0 ELSE rain_susceptibility_dense >= q END)"
_LABEL = f"""{_EVENTS}, {_ACTIVE},
cps AS (SELECT c.* FROM change_points c JOIN act USING (site_id, node_index)),
hit AS (SELECT e.site_id, e.date, {", ".join(f"count(DISTINCT node_index) FILTER (WHERE p.date <= e.date + {n}) AS n{n}, count(p.date) FILTER (WHERE p.date <= e.date + {n}) AS r{n}" for n in _LAGS)}
  FROM ev e LEFT JOIN cps p ON p.site_id = e.site_id AND p.date BETWEEN e.date AND e.date + 15 GROUP BY 1, 2),
na AS (SELECT site_id, count(*) AS a FROM act GROUP BY 1),
lab AS MATERIALIZED (SELECT ev.*, {", ".join(f"n{n} AS response_nodes_{n}d, r{n} AS cp_records_{n}d, n{n} / greatest(a, 1) AS trigger_probability_{n}d, n{n} >= 3 AS is_response_event_{n}d" for n in _LAGS)},
  greatest(n3, n7, n15) / greatest(a, 1) AS trigger_probability, greatest(n3, n7, n15) AS response_nodes_max,
  CASE WHEN n3 = greatest(n3, n7, n15) THEN 3 WHEN n7 = greatest(n3, n7, n15) THEN 7 ELSE 15 END AS dominant_response_window,
  n3 >= 3 OR n7 >= 3 OR n15 >= 3 AS is_response_event, CASE WHEN n3 >= 3 THEN 3 WHEN n7 >= 3 THEN 7 WHEN n15 >= 3 THEN 15 ELSE 0 END AS first_response_lag_days,
  n15 >= 3 AND NOT (n3 >= 3 OR n7 >= 3) AS delayed_response_event FROM ev JOIN hit USING (site_id, date) JOIN na USING (site_id))"""
_LAB_COLS = [f"{n}_{lag}d" for n in ("response_nodes", "cp_records", "is_response_event") for lag in _LAGS] + ["response_nodes_max", "dominant_response_window", "is_response_event", "first_response_lag_days", "delayed_response_event"]


def labelled(t):
    return rain.label_response(c.cut(_events(t)), t.change_points, rain.active_nodes(t.susceptibility))


@query("e6_label_response", f"WITH {_LABEL} SELECT site_id, date, {', '.join(_LAB_COLS)}, round(trigger_probability, 6) AS trigger_probability FROM lab")
def _(t):
    """Nodes that changed within each lag of an event."""
    return labelled(t).select("site_id", "date", *_LAB_COLS, "trigger_probability")


_WET = " + ".join(_SCALE(x) for x in ("pre15_rain_sum", "pre30_rain_sum", "pre60_rain_sum", "pre60_p90_days", "max_roll30_before"))
LEVELS = f"""{_LABEL},
wi AS MATERIALIZED (SELECT *, ({_WET}) / 5.0 AS antecedent_wetness_index FROM lab),
wq AS (SELECT site_id, quantile_cont(antecedent_wetness_index, 0.33) AS q33, quantile_cont(antecedent_wetness_index, 0.66) AS q66, quantile_cont(antecedent_wetness_index, 0.85) AS q85 FROM wi GROUP BY 1),
lv AS MATERIALIZED (SELECT wi.*, CASE WHEN antecedent_wetness_index >= q85 THEN 'W3_very_wet' WHEN antecedent_wetness_index >= q66 THEN 'W2_wet' WHEN antecedent_wetness_index >= q33 THEN 'W1_moderate' ELSE 'W0_dry' END AS wetness_level,
  CASE WHEN response_nodes_max < 3 THEN 'R0_below_event_threshold' WHEN trigger_probability >= 0.3 THEN 'R3_strong' WHEN trigger_probability >= 0.1 THEN 'R2_moderate' ELSE 'R0_below_event_threshold' END AS response_level,
  CASE WHEN rain_mm >= P95 THEN 'P95_extreme' WHEN rain_mm >= P90 THEN 'P90_heavy' WHEN rain_mm >= P75 THEN 'P75_moderate' ELSE 'below_P75_wet_background' END AS rain_level FROM wi JOIN wq USING (site_id)),
cls AS MATERIALIZED (SELECT *, CASE WHEN delayed_response_event AND response_level IN ('R1_weak', 'R2_moderate', 'R3_strong') THEN 'delayed_trigger'
  WHEN wetness_level IN ('W2_wet', 'W3_very_wet') AND response_level = 'R3_strong' AND rain_mm < P90 THEN 'wet_background_trigger'
  WHEN wetness_level IN ('W2_wet', 'W3_very_wet') AND response_level = 'R3_strong' THEN 'saturated_high_trigger'
  WHEN rain_mm >= P95 AND wetness_level = 'W0_dry' AND dominant_response_window >= 15 THEN 'dry_extreme_delayed'
  WHEN rain_mm >= P90 AND response_level IN ('R0_below_event_threshold', 'R1_weak') THEN 'strong_rain_weak_response'
  WHEN response_level IN ('R2_moderate', 'R3_strong') THEN 'moderate_trigger' ELSE 'weak_or_no_response' END AS event_class FROM lv)"""


def catalog(t):
    return rain.assign_levels(labelled(t))


@query("e7_assign_levels", f"WITH {LEVELS} SELECT site_id, date, event_id, wetness_level, response_level, rain_level, event_class, round(antecedent_wetness_index, 6) AS antecedent_wetness_index FROM cls")
def _(t):
    """Decision lists for the levels and the class of an event."""
    return catalog(t).select("site_id", "date", "event_id", "wetness_level", "response_level", "rain_level", "event_class", "antecedent_wetness_index")


@query("a6_event_class_summary", f"WITH {LEVELS} SELECT event_class, count(*) AS n, round(avg(rain_mm), 6) AS mean_rain, round(avg(antecedent_wetness_index), 6) AS mean_wetness, round(avg(trigger_probability), 6) AS mean_probability, max(response_nodes_max) AS most_nodes FROM cls GROUP BY event_class")
def _(t):
    return rain.class_summary(catalog(t))


@query("e8_active_nodes", f"WITH {_ACTIVE} SELECT site_id, node_index FROM act")
def _(t):
    return rain.active_nodes(t.susceptibility)


@query("e9_threshold_events", f"WITH {_THR} SELECT r.site_id, r.date, v.l AS threshold_level, g.lag AS lag_days, CAST(r.date + g.lag AS DATE) AS window_end FROM daily_rain r JOIN thr USING (site_id), (VALUES ('P50'), ('P75'), ('P90'), ('P95')) v(l), (VALUES (3), (7), (15), (30)) g(lag) WHERE rain_mm > 0 AND rain_mm >= CASE v.l WHEN 'P50' THEN P50 WHEN 'P75' THEN P75 WHEN 'P90' THEN P90 ELSE P95 END")
def _(t):
    return rain.threshold_events(t.daily_rain)


_ACQ = "acq AS (SELECT DISTINCT site_id, date FROM panel WHERE t >= 1)"
_ALIGN_WIN = ", ".join(
    [f"sum(rain_mm) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS rain_{n}d" for n in (3, 7, 15, 30)]
    + [f"max(rain_mm) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}" for n in (3, 7, 15)]
    + ["sum(rain_mm) OVER (w ROWS UNBOUNDED PRECEDING) AS cum", "list_reverse(list(rain_mm) OVER (w ROWS BETWEEN 44 PRECEDING AND CURRENT ROW)) AS win"]
)
_ALIGN = f"""{_ACQ}, dw AS MATERIALIZED (SELECT *, rain_mm AS rain_0d, {_ALIGN_WIN} FROM daily_rain WINDOW w AS (PARTITION BY site_id ORDER BY date)),
st AS (SELECT site_id, quantile_cont(rain_mm, 0.9) FILTER (WHERE rain_mm > 0) AS p90, quantile_cont(rain_mm, 0.95) FILTER (WHERE rain_mm > 0) AS p95, quantile_cont(rain_mm, 0.95) AS q95, quantile_cont(rain_30d, 0.5) AS med FROM dw GROUP BY 1),
al0 AS (SELECT dw.*, p90, p95, q95, med, coalesce(cum - lag(cum) OVER (PARTITION BY site_id ORDER BY date), rain_0d) AS rain_since_last,
  list_sum(list_transform(win, lambda x, i: x * pow(0.9, i - 1))) AS effective_exp45, list_sum(list_transform(win, lambda x, i: x / pow(i, 1.25))) AS effective_power45, rain_7d / greatest(rain_30d, 1e-6) AS short_long_ratio
  FROM dw JOIN acq USING (site_id, date) JOIN st USING (site_id)),
al1 AS (SELECT *, CAST(rain_7d > 0 AND rain_30d <= med AS DOUBLE) AS dry_to_wet, rain_3d * short_long_ratio AS runoff_proxy, effective_exp45 / greatest(q95, 1e-6) AS soil_anomaly, rain_15d AS water_balance_15d, {", ".join(f"CAST(m{n} >= p{p} AS DOUBLE) AS rain_event_p{p}_{n}d" for p in (90, 95) for n in (3, 7, 15))} FROM al0),
al AS MATERIALIZED (SELECT *, 0.40 * effective_exp45 + 0.25 * soil_anomaly + 0.20 * runoff_proxy + 0.15 * rain_since_last AS memory_index FROM al1)"""
_AL = ["rain_0d", "rain_3d", "rain_7d", "rain_15d", "rain_30d", "rain_since_last", "effective_exp45", "effective_power45", "short_long_ratio", "dry_to_wet", "runoff_proxy", "soil_anomaly", "water_balance_15d", "memory_index", *[f"rain_event_p{p}_{n}d" for p in (90, 95) for n in (3, 7, 15)]]


@query("e1_align_rain", f"WITH {_ALIGN} SELECT site_id, date, {_ROUND(_AL)} FROM al")
def _(t):
    """Range sums, sums between acquisitions, decayed sums and flags."""
    return rain.align_rain(t.daily_rain, t.acquisitions).select("site_id", "date", *_AL)


_SF = ["rain_3d", "rain_30d", "memory_index"]


@query("e2_standardise_features", f"WITH {_ALIGN} SELECT a.site_id, date, " + ", ".join(f"round(({x} - m_{x}) / CASE WHEN s_{x} >= 1e-6 THEN s_{x} ELSE 1 END, 6) AS {x}" for x in _SF) + " FROM al a JOIN (SELECT site_id, " + ", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}" for x in _SF) + " FROM al WHERE date < DATE '1999-01-01' GROUP BY 1) s ON s.site_id = a.site_id")
def _(t):
    """Fitted on the first years only."""
    d = rain.align_rain(t.daily_rain, t.acquisitions).select("site_id", "date", *_SF)
    return rain.standardised(d, _SF, F.col("date") < F.lit("1999-01-01").cast("date"))


_CLIMATE = "SELECT site_id, date, rain_mm / 2 AS rain_mm, CAST(day(date) % 7 AS DOUBLE) AS soil_moisture FROM daily_rain WHERE day(date) % 3 = 0"


def _climate(t):
    return t.daily_rain.where("day(date) % 3 = 0").select("site_id", "date", (F.col("rain_mm") / 2).alias("rain_mm"), (F.dayofmonth("date") % 7).cast("double").alias("soil_moisture"))


@query("j1_merge_climate", f"SELECT r.site_id, r.date, round(c.rain_mm, 6) AS rain_mm, c.soil_moisture FROM daily_rain r LEFT JOIN ({_CLIMATE}) c ON c.site_id = r.site_id AND c.date = r.date")
def _(t):
    return rain.merged_climate(t.daily_rain, _climate(t))


@query("s2_interpolated_climate", f"""WITH c AS ({_CLIMATE}), d AS (SELECT r.site_id, r.date, date_diff('day', DATE '1970-01-01', r.date) AS n, c.soil_moisture AS v FROM daily_rain r LEFT JOIN c ON c.site_id = r.site_id AND c.date = r.date),
e AS (SELECT *, last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS v0, first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
 last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS p0, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM d WINDOW w AS (PARTITION BY site_id ORDER BY n))
SELECT site_id, date, round(CASE WHEN p0 = p1 THEN v0 ELSE coalesce(v0 + (v1 - v0) * (n - p0) / (p1 - p0), v0, v1, 0) END, 6) AS soil_moisture FROM e""")
def _(t):
    d = t.daily_rain.select("site_id", "date").join(_climate(t).drop("rain_mm"), ["site_id", "date"], "left").withColumn("n", F.unix_date("date"))
    return c.interpolated(d, ["site_id"], "n", "soil_moisture").drop("n")


@query("w5_rain_anomaly", "WITH s AS (SELECT site_id, avg(rain_mm) AS m, stddev_pop(rain_mm) AS s FROM daily_rain GROUP BY 1) SELECT r.site_id, date, round((avg(rain_mm) OVER (PARTITION BY r.site_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) - m) / CASE WHEN s >= 1e-6 THEN s ELSE 1 END, 6) AS anomaly FROM daily_rain r JOIN s ON s.site_id = r.site_id")
def _(t):
    d = c.with_stats(t.daily_rain, ["site_id"], m=F.avg("rain_mm"), s=F.stddev_pop("rain_mm"))
    return d.select("site_id", "date", ((F.avg("rain_mm").over(rain._rows(-29, 0)) - F.col("m")) / c.safe_std(F.col("s"))).alias("anomaly"))


@query("a24_completeness_audit", """WITH o AS (SELECT l_suppkey AS site_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS r FROM lineitem GROUP BY 1, 2)
SELECT r.site_id, count(*) AS expected, count(o.r) AS present, count(*) - count(o.r) AS missing, count(*) FILTER (WHERE o.r < 0) AS negative, round(min(o.r), 6) AS least, round(max(o.r), 6) AS most, round(avg(o.r), 6) AS mean
FROM daily_rain r LEFT JOIN o ON o.site_id = r.site_id AND o.date = r.date GROUP BY 1""")
def _(t):
    """Expected against present days; J10 gives the missing ones."""
    have = t.lines.groupBy("site_id", "date").agg(F.sum("l_quantity").alias("r"))
    d = t.daily_rain.select("site_id", "date").join(have, ["site_id", "date"], "left")
    return d.groupBy("site_id").agg(F.count("*").alias("expected"), F.count("r").alias("present"), F.count(F.when(F.col("r").isNull(), 1)).alias("missing"), F.count(F.when(F.col("r") < 0, 1)).alias("negative"), F.min("r").alias("least"), F.max("r").alias("most"), F.avg("r").alias("mean"))


@query("j10_missing_days", "WITH o AS (SELECT DISTINCT l_suppkey AS site_id, CAST(l_shipdate AS DATE) AS date FROM lineitem) SELECT r.site_id, r.date FROM daily_rain r ANTI JOIN o ON o.site_id = r.site_id AND o.date = r.date")
def _(t):
    return t.daily_rain.select("site_id", "date").join(t.lines.select("site_id", "date"), ["site_id", "date"], "left_anti")
