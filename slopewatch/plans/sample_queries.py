"""Queries on samples, folds, forecasts and event contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.functions import common as c
from slopewatch.operators import samples as s
from slopewatch.plans import rain_queries as rq
from slopewatch.plans.registry import query

_CPS = (30, 40, 50)
_FOLDS = f"""fd0 AS (SELECT site_id, start, is_fallback, cp, greatest(0, cp - 12) AS b FROM samples, (VALUES {", ".join(f"({x})" for x in _CPS)}) v(cp)),
fd1 AS (SELECT *, CASE WHEN start < greatest(0, b - 12) THEN 'train' WHEN start < b THEN 'val' WHEN start < b + 12 THEN 'test' END AS part FROM fd0),
fd2 AS (SELECT *, count(*) FILTER (WHERE part = 'train') OVER w AS a, count(*) FILTER (WHERE part = 'val') OVER w AS v, count(*) FILTER (WHERE part = 'test') OVER w AS tt, count(*) FILTER (WHERE part = 'test' AND is_fallback) OVER w AS tf FROM fd1 WINDOW w AS (PARTITION BY site_id, cp)),
folds AS MATERIALIZED (SELECT site_id, 'cp_' || cp AS fold, start, part, is_fallback, v, tt, tf FROM fd2 WHERE part IS NOT NULL AND a >= 6 AND v >= 4 AND tt >= 4)"""


def folds(t):
    return s.rolling_folds(t.samples, _CPS, 12, val=12, test=12, least=(6, 4, 4))


@query("m1_fixed_split", "SELECT DISTINCT site_id, t, CASE WHEN t < 50 THEN 'train' WHEN t < 65 THEN 'val' ELSE 'test' END AS part FROM panel")
def _(t):
    return t.panel.select("site_id", "t").distinct().select("site_id", "t", s.fixed_split(F.col("t"), 50, 15).alias("part"))


@query("m2_rolling_folds", f"WITH {_FOLDS} SELECT site_id, fold, start, part FROM folds")
def _(t):
    return folds(t)


@query("m3_stratified_split", """WITH x AS (SELECT site_id, start, start // 20 AS stage FROM samples), y AS (SELECT *, count(*) OVER (PARTITION BY site_id, stage) AS n, row_number() OVER (PARTITION BY site_id, stage ORDER BY (start * 7919 + 7 * 104729 + start % 11 * 613) % 65521, start) AS i FROM x),
z AS (SELECT *, greatest(1, floor(0.7 * n + 0.5)) AS a, greatest(1, floor(0.15 * n + 0.5)) AS b FROM y), u AS (SELECT *, CASE WHEN a + b >= n THEN greatest(1, n - 2) ELSE a END AS ta, CASE WHEN a + b >= n THEN 1 ELSE b END AS tb FROM z)
SELECT site_id, start, stage, CASE WHEN n < 6 OR i <= ta THEN 'train' WHEN i <= ta + tb THEN 'val' ELSE 'test' END AS part FROM u""")
def _(t):
    d = t.samples.select("site_id", "start", F.floor(F.col("start") / 20).alias("stage"))
    return s.stratified_split(d, "stage")


@query("m4_source_balanced_validation", f"""WITH {_FOLDS}, pl AS (SELECT *, least(v, CAST(floor(v * tf / greatest(tt, 1) + 0.5) AS BIGINT)) AS wf, row_number() OVER (PARTITION BY site_id, fold, is_fallback ORDER BY start DESC) AS r FROM folds WHERE part <> 'test'),
p2 AS (SELECT *, r <= CASE WHEN is_fallback THEN wf ELSE v - wf END AS chosen FROM pl), p3 AS (SELECT *, v - sum(CAST(chosen AS INT)) OVER (PARTITION BY site_id, fold) AS short, row_number() OVER (PARTITION BY site_id, fold, chosen ORDER BY start DESC) AS o FROM p2)
SELECT site_id, fold, start, is_fallback, CASE WHEN chosen OR o <= short THEN 'val' ELSE 'train' END AS part FROM p3 UNION ALL SELECT site_id, fold, start, is_fallback, part FROM folds WHERE part = 'test'""")
def _(t):
    """U4: new training samples are the candidates without the new validation ones."""
    return s.source_balanced_val(folds(t).join(t.samples.select("site_id", "start", "is_fallback"), ["site_id", "start"]))


@query("a26_coverage_by_fold", f"WITH {_FOLDS} SELECT fold, part, count(*) AS n, round(avg(CAST(is_fallback AS INT)), 6) AS fallback_share FROM folds GROUP BY 1, 2")
def _(t):
    d = folds(t).join(t.samples.select("site_id", "start", "is_fallback"), ["site_id", "start"])
    return d.groupBy("fold", "part").agg(F.count("*").alias("n"), F.avg(F.col("is_fallback").cast("int")).alias("fallback_share"))


_FC = """fi AS (SELECT s.*, (SELECT max(issue_date) FROM forecast f WHERE f.site_id = s.site_id AND f.issue_date <= s.origin_date) AS issue FROM samples s),
fc0 AS (SELECT fi.site_id, start, split, origin_date, issue, date_diff('day', issue, origin_date) AS age, """ + ", ".join(f"coalesce(sum(forecast_rain_mm) FILTER (WHERE valid_date > origin_date AND valid_date <= origin_date + {n}), 0) AS r{n}" for n in (1, 3, 7, 15)) + """,
 max(CAST(source LIKE '%fallback%' AS INT)) AS fb FROM fi LEFT JOIN forecast f ON f.site_id = fi.site_id AND f.issue_date = issue GROUP BY 1, 2, 3, 4, 5, 6),
fc1 AS (SELECT site_id, start, split, origin_date, coalesce(age <= 15, false) AS ok, coalesce(age, 15) AS age, fb, """ + ", ".join(f"CASE WHEN age <= 15 THEN r{n} ELSE 0 END AS forecast_rain_{n}d" for n in (1, 3, 7, 15)) + """ FROM fc0),
fq AS (SELECT site_id, quantile_cont(forecast_rain_15d, 0.9) FILTER (WHERE forecast_rain_15d > 0) AS p90, quantile_cont(forecast_rain_15d, 0.95) FILTER (WHERE forecast_rain_15d > 0) AS p95 FROM fc1 WHERE split = 'train' GROUP BY 1),
fc AS MATERIALIZED (SELECT fc1.site_id, start, split, CAST(ok AS DOUBLE) AS forecast_available, CASE WHEN ok THEN CAST(fb AS DOUBLE) ELSE 0 END AS forecast_is_fallback, CAST(age AS DOUBLE) AS forecast_issue_age_days, forecast_rain_1d, forecast_rain_3d, forecast_rain_7d, forecast_rain_15d,
 CAST(coalesce(forecast_rain_15d >= p90, false) AS DOUBLE) AS forecast_event_p90_15d, CAST(coalesce(forecast_rain_15d >= p95, false) AS DOUBLE) AS forecast_event_p95_15d FROM fc1 LEFT JOIN fq ON fq.site_id = fc1.site_id)"""
_FCC = ["forecast_available", "forecast_is_fallback", "forecast_issue_age_days", "forecast_rain_1d", "forecast_rain_3d", "forecast_rain_7d", "forecast_rain_15d", "forecast_event_p90_15d", "forecast_event_p95_15d"]


@query("m6_forecast_context", f"WITH {_FC} SELECT site_id, start, {', '.join(_FCC)} FROM fc")
def _(t):
    """As-of join with the latest issue, and the rows of that issue."""
    return s.forecast_context(t.samples, t.forecast).select("site_id", "start", *_FCC)


@query("p13_normalised_context", f"""WITH {_FC}, q AS (SELECT site_id, start, split, least(greatest(forecast_available, 0), 1) AS forecast_available, least(forecast_issue_age_days, 15) / 15 AS forecast_issue_age_days, ln(1 + greatest(forecast_rain_15d, 0)) AS x FROM fc)
SELECT q.site_id, start, forecast_available, round(forecast_issue_age_days, 6) AS forecast_issue_age_days, round(least(greatest((x - m) / CASE WHEN s >= 1e-6 THEN s ELSE 1 END, -5), 5), 6) AS forecast_rain_15d FROM q JOIN (SELECT site_id, avg(x) AS m, stddev_pop(x) AS s FROM q WHERE split = 'train' GROUP BY 1) st ON st.site_id = q.site_id""")
def _(t):
    d = s.normalised_context(s.forecast_context(t.samples, t.forecast), ["forecast_available"], {"forecast_issue_age_days": 15.0}, ["forecast_rain_15d"])
    return d.select("site_id", "start", "forecast_available", "forecast_issue_age_days", "forecast_rain_15d")


_PRIOR = f"""{rq.LEVELS}, pr AS MATERIALIZED (SELECT *, CASE WHEN n > 0 THEN (s + 1.0) / (n + 2) WHEN a > 0 THEN (b + 1.0) / (a + 2) ELSE 0.5 END AS historical_trigger_probability, CASE WHEN n > 0 THEN n ELSE a END AS historical_trigger_count FROM (SELECT *, count(*) OVER x AS n, coalesce(sum(CAST(is_response_event AS INT)) OVER x, 0) AS s,
 count(*) OVER y AS a, coalesce(sum(CAST(is_response_event AS INT)) OVER y, 0) AS b FROM cls WINDOW x AS (PARTITION BY site_id, wetness_level, rain_level ORDER BY date, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y AS (PARTITION BY site_id ORDER BY date, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


@query("w9_event_priors", f"WITH {_PRIOR} SELECT site_id, event_id, round(historical_trigger_probability, 6) AS historical_trigger_probability, historical_trigger_count FROM pr")
def _(t):
    return s.event_priors(rq.catalog(t)).select("site_id", "event_id", "historical_trigger_probability", "historical_trigger_count")


_CODE = lambda x: f"CASE WHEN {x} LIKE 'W3%' OR {x} LIKE 'P95%' THEN 3 WHEN {x} LIKE 'W2%' OR {x} LIKE 'P90%' THEN 2 WHEN {x} LIKE 'W1%' OR {x} LIKE 'P75%' THEN 1 ELSE 0 END"
_EC = f"""{_PRIOR}, ei AS (SELECT s.site_id, s.start, s.origin_date, max(e.date) AS d FROM samples s LEFT JOIN pr e ON e.site_id = s.site_id AND e.date <= s.origin_date GROUP BY 1, 2, 3),
ec AS MATERIALIZED (SELECT ei.site_id, start, coalesce(date_diff('day', d, origin_date) <= 60, false) AS ok, date_diff('day', d, origin_date) AS age, e.* EXCLUDE (site_id) FROM ei LEFT JOIN pr e ON e.site_id = ei.site_id AND e.date = d)"""


@query("m7_event_context", f"""WITH {_EC} SELECT site_id, start, CAST(ok AS DOUBLE) AS event_available, CAST(CASE WHEN ok THEN age ELSE 60 END AS DOUBLE) AS event_age_days, CAST(ok AND age <= 3 AS DOUBLE) AS event_active_3d, CAST(ok AND age <= 15 AS DOUBLE) AS event_active_15d,
 round(CASE WHEN ok THEN rain_mm ELSE 0 END, 6) AS event_rain_mm, round(CASE WHEN ok THEN antecedent_wetness_index ELSE 0 END, 6) AS event_antecedent_wetness_index, CASE WHEN ok THEN {_CODE("wetness_level")} ELSE 0 END AS event_wetness_level_code, CASE WHEN ok THEN {_CODE("rain_level")} ELSE 0 END AS event_rain_level_code,
 round(CASE WHEN ok THEN historical_trigger_probability ELSE 0 END, 6) AS event_historical_trigger_probability FROM ec""")
def _(t):
    """The latest event by the origin, one row for each sample."""
    d = s.event_context(t.samples, s.event_priors(rq.catalog(t)))
    return d.select("site_id", "start", "event_available", "event_age_days", "event_active_3d", "event_active_15d", "event_rain_mm", "event_antecedent_wetness_index", "event_wetness_level_code", "event_rain_level_code", "event_historical_trigger_probability")


@query("m8_event_weights", f"""WITH {_EC}, x AS (SELECT site_id, start, CAST(ok AND age <= 3 AS INT) AS a, 0.75 * CAST(ok AND age <= 7 AS INT) AS b, 0.5 * CAST(ok AND age <= 15 AS INT) AS c, CASE WHEN ok THEN antecedent_wetness_index ELSE 0 END AS w FROM ec)
SELECT site_id, start, round(1 + greatest(a, b, c, 0.25 * CASE WHEN max(w) OVER p - min(w) OVER p < 1e-6 THEN 0 ELSE (w - min(w) OVER p) / (max(w) OVER p - min(w) OVER p) END), 6) AS weight FROM x WINDOW p AS (PARTITION BY site_id)""")
def _(t):
    return s.event_weights(c.cut(s.event_context(t.samples, s.event_priors(rq.catalog(t))))).select("site_id", "start", "weight")


@query("m9_sample_in_event", "WITH q AS (SELECT site_id, t, max(CAST(profile = 'strict' AS INT)) AS f FROM change_points GROUP BY 1, 2) SELECT s.site_id, s.start, coalesce(max(f), 0) AS in_event FROM samples s LEFT JOIN q ON q.site_id = s.site_id AND q.t BETWEEN s.start AND s.start + 11 GROUP BY 1, 2")
def _(t):
    f = t.change_points.groupBy("site_id", "t").agg(F.max((F.col("profile") == "strict").cast("int")).alias("f"))
    d = t.samples.withColumn("t", F.explode(F.sequence(F.col("start"), F.col("start") + 11))).join(f, ["site_id", "t"], "left")
    return d.groupBy("site_id", "start").agg(F.coalesce(F.max("f"), F.lit(0)).alias("in_event"))


_MISS = "miss AS (SELECT site_id, origin_date FROM samples s WHERE NOT EXISTS (SELECT 1 FROM forecast f WHERE f.site_id = s.site_id AND f.issue_date = s.origin_date))"


def _missing(t):
    have = t.forecast.select("site_id", F.col("issue_date").alias("origin_date")).distinct()
    return t.samples.select("site_id", "origin_date").join(have, ["site_id", "origin_date"], "left_anti")


@query("m10_climatology_fill", f"""WITH {_MISS}, l AS (SELECT m.*, CAST(g.range AS INT) AS lead, CAST(origin_date + to_days(CAST(g.range AS INTEGER)) AS DATE) AS valid_date FROM miss m, range(1, 16) g),
c AS (SELECT l.site_id, l.origin_date, l.lead, l.valid_date, sum(rain_mm) AS s, count(r.date) AS n FROM l JOIN daily_rain r ON r.site_id = l.site_id AND r.date < l.origin_date AND least(abs(dayofyear(r.date) - dayofyear(valid_date)), 366 - abs(dayofyear(r.date) - dayofyear(valid_date))) <= 30 GROUP BY 1, 2, 3, 4),
b AS (SELECT site_id, date, avg(rain_mm) OVER (PARTITION BY site_id ORDER BY date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS m90 FROM daily_rain)
SELECT l.site_id, l.origin_date, l.lead, l.valid_date, round(greatest(CASE WHEN n >= 5 THEN s / n ELSE coalesce(m90, 0) END, 0), 6) AS forecast_rain_mm FROM l LEFT JOIN c USING (site_id, origin_date, lead, valid_date) LEFT JOIN b ON b.site_id = l.site_id AND b.date = l.origin_date""")
def _(t):
    """Origins without a forecast get the seasonal mean of earlier rain."""
    return s.climatology_fill(_missing(t), t.daily_rain)


@query("m11_analog_fill")
def _(t):
    """What followed the most similar earlier days."""
    return s.analog_fill(_missing(t), t.daily_rain)


@query("a25_forecast_profile", "SELECT site_id, count(*) AS n, count(DISTINCT issue_date) AS issues, min(date_diff('day', issue_date, valid_date)) AS lead_min, max(date_diff('day', issue_date, valid_date)) AS lead_max, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM forecast GROUP BY 1")
def _(t):
    lead = F.datediff("valid_date", "issue_date").cast("long")
    return t.forecast.groupBy("site_id").agg(F.count("*").alias("n"), F.count_distinct("issue_date").alias("issues"), F.min(lead).alias("lead_min"), F.max(lead).alias("lead_max"), F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"))


@query("a27_missing_issues_per_year", "SELECT y, count(*) AS missing FROM (SELECT site_id, CAST(DATE '1995-01-02' + to_days(CAST(12 * i.range AS INTEGER)) AS DATE) AS d, year(DATE '1995-01-02' + to_days(CAST(12 * i.range AS INTEGER))) AS y FROM sites, range(208) i) e ANTI JOIN forecast f ON f.site_id = e.site_id AND f.issue_date = e.d GROUP BY 1")
def _(t):
    every = t.sites.withColumn("issue_date", F.explode(F.sequence(F.lit("1995-01-02").cast("date"), F.date_add(F.lit("1995-01-02").cast("date"), 12 * 207), F.expr("interval 12 days"))))
    return every.join(t.forecast, ["site_id", "issue_date"], "left_anti").groupBy(F.year("issue_date").cast("long").alias("y")).agg(F.count("*").alias("missing"))


@query("s8_forecast_upsert", "SELECT site_id, issue_date, valid_date, source, round(forecast_rain_mm + CASE WHEN issue_no % 3 = 0 THEN 1 ELSE 0 END, 6) AS forecast_rain_mm FROM forecast")
def _(t):
    """New rows replace those of the same issue, valid date and source."""
    new = t.forecast.where("issue_no % 3 = 0").withColumn("forecast_rain_mm", F.col("forecast_rain_mm") + 1)
    from slopewatch.sources.tables import upsert

    return upsert(t.forecast, new, ["site_id", "issue_date", "valid_date", "source"]).drop("issue_no")


@query("p9_fallback_flag", "SELECT site_id, issue_date, lower(source) LIKE '%fallback%' OR lower(source) LIKE '%climatology%' AS is_fallback FROM forecast")
def _(t):
    return t.forecast.select("site_id", "issue_date", F.lower("source").rlike("fallback|climatology").alias("is_fallback"))
