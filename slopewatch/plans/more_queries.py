"""Queries on grids, scaling, lookups, feature assembly and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slopewatch.functions import common as c
from slopewatch.operators import evaluate as ev
from slopewatch.operators import panel as p
from slopewatch.operators import samples as s
from slopewatch.plans import panel_queries as pq
from slopewatch.plans import rain_queries as rq
from slopewatch.plans.registry import query
from slopewatch.sources import tables

_GRID = "grid AS MATERIALIZED (SELECT site_id, date, v.r AS row, v.k AS col, CASE WHEN (day(date) + v.r + v.k) % 13 = 0 THEN -9999.0 ELSE rain_mm * (1 + v.r * 0.5 - v.k * 0.25) END AS rain_mm FROM daily_rain, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(r, k))"


def _grid(t):
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(k).alias("col")) for r in (0, 1) for k in (0, 1)]))
    d = t.daily_rain.withColumn("x", cells).select("site_id", "date", "x.row", "x.col", "rain_mm")
    bad = (F.dayofmonth("date") + F.col("row") + F.col("col")) % 13 == 0
    return d.withColumn("rain_mm", F.when(bad, -9999.0).otherwise(F.col("rain_mm") * (1 + F.col("row") * 0.5 - F.col("col") * 0.25)))


@query("p4_cropped_grid", f"WITH {_GRID} SELECT site_id, date, row, col, round(CASE WHEN rain_mm >= -9000 THEN rain_mm END, 6) AS rain_mm, round(-180 + (col + 0.5) * 0.05, 6) AS lon, round(50 - (row + 0.5) * 0.05, 6) AS lat FROM grid WHERE row = 0")
def _(t):
    """Cell centres; sentinels become null."""
    return tables.cell_centres(tables.crop_grid(_grid(t), (0, 0), (0, 1)))


@query("a3_site_daily_mean", f"WITH {_GRID} SELECT site_id, date, round(avg(CASE WHEN rain_mm >= -9000 THEN rain_mm END), 6) AS rain_mm FROM grid GROUP BY 1, 2")
def _(t):
    """What is written beside the grid."""
    return tables.site_daily_mean(tables.crop_grid(_grid(t), (0, 1), (0, 1)))


@query("s5_susceptibility_by_node", "SELECT n.site_id, n.node_index, round(greatest(0, least(1, coalesce(s.rain_susceptibility * 2, 0))), 6) AS rain_susceptibility FROM nodes n LEFT JOIN susceptibility s ON s.site_id = n.site_id AND s.node_index = n.node_index AND s.node_index % 3 <> 0")
def _(t):
    part = t.susceptibility.where("node_index % 3 <> 0").withColumn("rain_susceptibility", F.col("rain_susceptibility") * 2)
    return tables.read_susceptibility(t.nodes, part)


@query("p5_z_score_round_trip", "WITH m AS (SELECT site_id, avg(disp) AS m, stddev_pop(disp) AS s FROM panel WHERE t < 50 GROUP BY 1) SELECT p.site_id, node_index, t, round((disp - m) / CASE WHEN s >= 1e-6 THEN s ELSE 1 END, 6) AS z, round(disp, 6) AS again FROM panel p JOIN m ON m.site_id = p.site_id")
def _(t):
    """Values are put back by the same mean and deviation."""
    m = t.panel.where("t < 50").groupBy("site_id").agg(F.avg("disp").alias("m"), F.stddev_pop("disp").alias("s"))
    d = t.panel.join(m, "site_id").withColumn("z", c.z_score(F.col("disp"), F.col("m"), c.safe_std(F.col("s"))))
    return d.select("site_id", "node_index", "t", "z", c.de_normalised(F.col("z"), F.col("m"), c.safe_std(F.col("s"))).alias("again"))


_Q = lambda q: f"quantile_cont(elevation, {q}) OVER (PARTITION BY site_id)"


@query("p6_scaled_elevation", f"SELECT site_id, node_index, round(CASE WHEN max(elevation) OVER w - min(elevation) OVER w < 1e-6 THEN 0 ELSE (elevation - min(elevation) OVER w) / (max(elevation) OVER w - min(elevation) OVER w) END, 6) AS min_max, round(greatest(0, (elevation - {_Q(0.25)}) / greatest({_Q(0.75)} - {_Q(0.25)}, 1e-6)), 6) AS robust FROM nodes WINDOW w AS (PARTITION BY site_id)")
def _(t):
    d = c.robust_scales(c.min_max(t.nodes, ["site_id"], "elevation", "min_max"), ["site_id"], ["elevation"])
    return d.select("site_id", "node_index", "min_max", F.col("scaled_elevation").alias("robust"))


@query("p10_level_codes", f"WITH {rq.LEVELS} SELECT site_id, event_id, CASE WHEN wetness_level LIKE 'W3%' THEN 3 WHEN wetness_level LIKE 'W2%' THEN 2 WHEN wetness_level LIKE 'W1%' THEN 1 ELSE 0 END AS wetness_code, CASE WHEN rain_level LIKE 'P95%' THEN 3 WHEN rain_level LIKE 'P90%' THEN 2 WHEN rain_level LIKE 'P75%' THEN 1 ELSE 0 END AS rain_code FROM cls")
def _(t):
    return rq.catalog(t).select("site_id", "event_id", s.level_code(F.col("wetness_level")).alias("wetness_code"), s.level_code(F.col("rain_level")).alias("rain_code"))


@query("p12_percentage_gain", "WITH m AS (SELECT site_id, avg(abs(y_pred - y_true)) FILTER (WHERE model = 'persistence') AS r, avg(abs(y_pred - y_true)) FILTER (WHERE model = 'trend') AS m FROM predictions GROUP BY 1) SELECT site_id, round(100 * (r - m) / greatest(r, 1e-6), 6) AS gain FROM m")
def _(t):
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    g = t.predictions.groupBy("site_id").agg(F.avg(F.when(F.col("model") == "persistence", e)).alias("r"), F.avg(F.when(F.col("model") == "trend", e)).alias("m"))
    return g.select("site_id", ev.gain(F.col("r"), F.col("m")).alias("gain"))


@query("j11_strict_lookup", "SELECT site_id, start, issue FROM (SELECT s.site_id, s.start, min(f.issue_no) AS issue FROM samples s JOIN forecast f ON f.site_id = s.site_id AND (s.start + f.issue_no) % 7 = 0 GROUP BY 1, 2)")
def _(t):
    """The first row of a key wins; a sample without a row raises."""
    keyed = t.forecast.select("site_id", "issue_no", (F.pmod(-F.col("issue_no"), F.lit(7))).alias("k"))
    first = keyed.groupBy("site_id", "k").agg(F.min("issue_no").alias("issue"))
    d = t.samples.withColumn("k", F.col("start") % 7).join(first, ["site_id", "k"], "left")
    return d.select("site_id", "start", F.coalesce("issue", F.raise_error(F.lit("a sample has no row"))).cast("long").alias("issue"))


_FEAT = f"{pq._GROUP}, ft AS (SELECT s.site_id, s.start, g.absolute AS at_origin, k.absolute AS at_target FROM samples s LEFT JOIN grp g ON g.site_id = s.site_id AND g.t = least(s.start + 11, 82) LEFT JOIN grp k ON k.site_id = s.site_id AND k.t = least(s.start + 16, 82))"


@query("j22_sample_features", f"WITH {_FEAT} SELECT site_id, start, round(coalesce(at_origin, 0), 6) AS at_origin, round(coalesce(at_target, 0), 6) AS at_target FROM ft")
def _(t):
    """Features of the interval at the sample's origin, and (for comparison) of the last one inside its target."""
    g = p.group_increments(t.panel).select("site_id", "t", "absolute")
    d = t.samples.select("site_id", "start")
    for name, k in (("at_origin", 11), ("at_target", 16)):
        d = d.withColumn("t", F.least(F.col("start") + k, F.lit(82))).join(g.withColumnRenamed("absolute", name), ["site_id", "t"], "left").drop("t")
    return d.fillna(0.0)


@query("t4_representative_nodes", f"WITH {pq._MOTION}, b AS (SELECT *, ntile(3) OVER (PARTITION BY site_id ORDER BY round(motion_std, 9), node_index) AS band FROM mot), m AS (SELECT *, abs(motion_std - quantile_cont(motion_std, 0.5) OVER (PARTITION BY site_id, band)) AS d FROM b) SELECT site_id, CAST(band AS INT) AS band, arg_min(node_index, struct_pack(a := round(d, 9), b := node_index)) AS node_index FROM m GROUP BY 1, 2")
def _(t):
    """The node nearest to the median of each third by motion."""
    d = p.motion(t.panel).withColumn("band", F.ntile(3).over(Window.partitionBy("site_id").orderBy(F.round("motion_std", 9), "node_index")))
    d = c.with_stats(d, ["site_id", "band"], _m=F.percentile("motion_std", F.lit(0.5)))
    return d.groupBy("site_id", "band").agg(F.min_by("node_index", F.struct(F.round(F.abs(F.col("motion_std") - F.col("_m")), 9), "node_index")).alias("node_index"))


_LINK = f"{pq._GROUP}, x AS (SELECT g.site_id, v.f, l.lag, corr(CASE v.f WHEN 'signed' THEN b.signed ELSE b.absolute END, g.absolute) AS r FROM grp g JOIN grp b ON b.site_id = g.site_id, (VALUES ('signed'), ('absolute')) v(f), (VALUES (1), (2), (3)) l(lag) WHERE b.t = g.t - l.lag GROUP BY 1, 2, 3)"


@query("t7_gate_features", f"WITH {_LINK} SELECT site_id, f AS feature, CAST(lag AS INT) AS lag, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY site_id, f ORDER BY round(abs(r), 9) DESC, lag) AS k FROM x) WHERE k = 1")
def _(t):
    """The best lag of each feature by correlation with the response."""
    g = p.group_increments(t.panel).select("site_id", "t", "signed", "absolute")
    f = g.withColumn("x", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in ("signed", "absolute")]))).withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    f = f.select("site_id", (F.col("t") + F.col("lag")).alias("t"), "x.feature", "lag", "x.v").join(g.select("site_id", "t", F.col("absolute").alias("y")), ["site_id", "t"])
    r = f.groupBy("site_id", "feature", "lag").agg(F.corr("v", "y").alias("r"))
    return c.top_k(r, ["site_id", "feature"], [F.desc(F.round(F.abs("r"), 9)), "lag"], 1).drop("rank")


_SEEDS = "cf AS (SELECT seed, model, horizon, avg(abs(y_pred - y_true)) AS mae FROM predictions WHERE split = 'val' GROUP BY 1, 2, 3), rk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(mae, 9), model, horizon) AS pos FROM cf), sl AS (SELECT model, horizon, min(pos) AS pos FROM rk WHERE pos <= 9 GROUP BY 1, 2 HAVING count(DISTINCT seed) = 3)"


@query("t8_shortlist", f"WITH {_SEEDS} SELECT model, horizon, CAST(pos AS INT) AS pos FROM sl ORDER BY pos, model, horizon LIMIT 5")
def _(t):
    """Configurations that are among the best nine of every seed, the first five by their best place."""
    m = t.predictions.where("split = 'val'").groupBy("seed", "model", "horizon").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    r = m.withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy(F.round("mae", 9), "model", "horizon"))).where("pos <= 9")
    g = r.groupBy("model", "horizon").agg(F.min("pos").alias("pos"), F.count_distinct("seed").alias("n")).where("n = 3")
    return g.drop("n").orderBy("pos", "model", "horizon").limit(5)


@query("u1_union_of_sources", "SELECT site_id, issue_date, source, forecast_rain_mm AS rain, CAST(NULL AS DOUBLE) AS observed FROM forecast UNION ALL SELECT site_id, date, 'gauge', NULL, rain_mm FROM daily_rain")
def _(t):
    """Rows with differing columns, aligned by name."""
    a = t.forecast.select("site_id", "issue_date", "source", F.col("forecast_rain_mm").alias("rain"))
    b = t.daily_rain.select("site_id", F.col("date").alias("issue_date"), F.lit("gauge").alias("source"), F.col("rain_mm").alias("observed"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u5_first_per_key", "SELECT site_id, CAST(min(issue_date) AS DATE) AS issue_date, source FROM forecast GROUP BY 1, 3")
def _(t):
    return c.top_k(t.forecast, ["site_id", "source"], ["issue_date"], 1).select("site_id", "issue_date", "source")


@query("c3_mdl_segmentation")
def _(t):
    """Greedy splits of the mean, spread and top signals of each site, as long as they shorten its description."""
    return p.mdl_segmentation(p.cpd_signal(t.panel), ["site_id"], ["mean", "std", "top"])


@query("v13_mechanism_table", f"WITH {pq._MOTION} SELECT n.site_id, CAST(floor((elevation - 2500) / 70) AS BIGINT) AS belt, count(*) AS nodes, round(avg(motion_std), 6) AS motion, round(avg(total_change), 6) AS change FROM nodes n JOIN mot m ON m.site_id = n.site_id AND m.node_index = n.node_index GROUP BY 1, 2")
def _(t):
    """Motion by belts of elevation."""
    d = t.nodes.join(p.motion(t.panel), p.NODE).withColumn("belt", F.floor((F.col("elevation") - 2500) / 70))
    return d.groupBy("site_id", "belt").agg(F.count("*").alias("nodes"), F.avg("motion_std").alias("motion"), F.avg("total_change").alias("change"))


@query("s10_pack_round_trip", "SELECT site_id, count(*) AS rows_read, round(sum(disp), 6) AS disp_sum FROM panel GROUP BY 1")
def _(t):
    """A pack of each site's panel (each node an array in the order of months), written, read and unpacked again."""
    path = c.fresh_path(t.spark, "pack")
    tables.write_packs(t.panel, path)
    return tables.read_packs(t.spark, path).groupBy("site_id").agg(F.count("*").alias("rows_read"), F.sum("disp").alias("disp_sum"))
