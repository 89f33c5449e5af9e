"""Queries on the displacement panel, change points and the terrain graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopewatch.functions import common as c
from slopewatch.operators import panel as p
from slopewatch.plans.registry import query

_W = "(PARTITION BY site_id, node_index ORDER BY t)"
_INC = f"inc AS MATERIALIZED (SELECT *, disp - lag(disp) OVER {_W} AS signed FROM panel)"
_MOTION = f"{_INC}, mot AS MATERIALIZED (SELECT site_id, node_index, stddev_pop(signed) AS motion_std, arg_max(disp, t) - arg_min(disp, t) AS total_change FROM inc GROUP BY 1, 2)"
_TOP = f"{_MOTION}, top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(motion_std, 9) DESC, node_index) AS rank, count(*) OVER (PARTITION BY site_id) AS n FROM mot) WHERE rank <= greatest(1, floor(n * 0.1)))"


@query("s1_long_panel", "SELECT site_id, node_index, t, round(disp, 6) AS disp FROM panel")
def _(t):
    """Wide rows of 83 acquisitions back to long ones."""
    wide = t.panel.groupBy("site_id", "node_index").pivot("t", list(range(83))).agg(F.first("disp"))
    return p.long_panel(wide, ["site_id", "node_index"]).drop("date")


@query("s13_transposed_panel", "SELECT site_id, t, " + ", ".join(f'round(max(disp) FILTER (WHERE node_index = {i}), 6) AS "{i}"' for i in range(12)) + " FROM panel GROUP BY 1, 2")
def _(t):
    return p.transposed(t.panel, range(12))


@query("w7_increments", f"WITH {_INC} SELECT site_id, node_index, t, round(signed, 6) AS signed, round(abs(signed), 6) AS absolute, round(signed - lag(signed) OVER {_W}, 6) + 0.0 AS second FROM inc")
def _(t):
    return p.increments(t.panel).select("site_id", "node_index", "t", "signed", "absolute", "second")


_GROUP = f"{_INC}, grp AS MATERIALIZED (SELECT site_id, t, avg(signed) AS signed, avg(abs(signed)) AS absolute FROM inc WHERE signed IS NOT NULL GROUP BY 1, 2)"


@query("w7_group_increments", f"WITH {_GROUP} SELECT site_id, t, round(signed, 6) AS signed, round(absolute, 6) AS absolute, round(coalesce(signed - lag(signed) OVER (PARTITION BY site_id ORDER BY t), 0), 6) AS change FROM grp")
def _(t):
    return p.group_increments(t.panel)


@query("w8_decomposition", f"""WITH {_GROUP} SELECT site_id, t, round(avg(absolute) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS long_trend, round(avg(absolute) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS short_baseline,
round(absolute - avg(absolute) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS rain_disturbance, round(absolute - avg(absolute) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS short_shock FROM grp WINDOW w AS (PARTITION BY site_id ORDER BY t)""")
def _(t):
    return p.decomposed(p.group_increments(t.panel), ["site_id"], "absolute").select("site_id", "t", "long_trend", "short_baseline", "rain_disturbance", "short_shock")


@query("e15_multiscale_features", f"""WITH {_GROUP}, dec AS (SELECT site_id, t, absolute - avg(absolute) OVER (PARTITION BY site_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS x FROM grp),
z AS (SELECT d.site_id, d.t, (x - m) / CASE WHEN mad * 1.4826 >= 1e-6 THEN mad * 1.4826 WHEN s >= 1e-6 THEN s ELSE 1 END AS z FROM dec d JOIN
 (SELECT d.site_id, m, s, quantile_cont(abs(x - m), 0.5) AS mad FROM dec d JOIN (SELECT site_id, quantile_cont(x, 0.5) AS m, stddev_pop(x) AS s FROM dec GROUP BY 1) q ON q.site_id = d.site_id GROUP BY 1, 2, 3) q ON q.site_id = d.site_id)
SELECT site_id, t, round(z, 6) AS rain_disturbance_z, """ + ", ".join(f"round(coalesce(lag(z,{k}) OVER (PARTITION BY site_id ORDER BY t), 0), 6) AS gate_lag{k}" for k in (1, 3, 6)) + " FROM z")
def _(t):
    """Robust z-scores of the disturbance and their lags, 0 before the start."""
    d = p.decomposed(p.group_increments(t.panel), ["site_id"], "absolute")
    d = c.robust_z(d, ["site_id"], "rain_disturbance", "rain_disturbance_z")
    w = p.Window.partitionBy("site_id").orderBy("t")
    return d.select("site_id", "t", "rain_disturbance_z", *[F.coalesce(F.lag("rain_disturbance_z", k).over(w), F.lit(0.0)).alias(f"gate_lag{k}") for k in (1, 3, 6)])


@query("a9_node_motion", f"WITH {_MOTION} SELECT site_id, node_index, round(motion_std, 6) AS motion_std, round(total_change, 6) AS total_change FROM mot")
def _(t):
    return p.motion(t.panel)


@query("t1_top_moving_nodes", f"WITH {_TOP} SELECT site_id, node_index, CAST(rank AS INT) AS rank, round(motion_std, 6) AS motion_std FROM top")
def _(t):
    return p.top_moving(t.panel).select("site_id", "node_index", "rank", "motion_std")


@query("u3_motion_and_rain_nodes", f"WITH {_TOP} SELECT site_id, node_index FROM top INTERSECT SELECT site_id, node_index FROM susceptibility WHERE rain_susceptibility > 0")
def _(t):
    return p.top_moving(t.panel).select("site_id", "node_index").intersect(t.susceptibility.where("rain_susceptibility > 0").select("site_id", "node_index"))


@query("w15_sample_windows", f"SELECT site_id, node_index, start, round(h_sum, 6) AS history_sum, round(t_sum, 6) AS target_sum FROM (SELECT site_id, node_index, t AS start, sum(disp) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS h_sum, sum(disp) OVER (w ROWS BETWEEN 12 FOLLOWING AND 16 FOLLOWING) AS t_sum, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 16 FOLLOWING) AS n FROM panel WINDOW w AS {_W}) WHERE n = 17")
def _(t):
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return p.sample_windows(t.panel, 12, 5).select("site_id", "node_index", "start", total("history").alias("history_sum"), total("target").alias("target_sum"))


_CPS = "cpl AS (SELECT site_id, list_sort(list(DISTINCT t)) AS cps FROM change_points WHERE profile = 'strict' GROUP BY 1)"


@query("w11_stages", f"""WITH {_CPS}, x AS (SELECT s.site_id, m.range AS t, list_filter(cps, lambda q: q <= m.range) AS b, list_filter(cps, lambda q: q > m.range) AS a FROM cpl s, range(83) m)
SELECT site_id, t, CAST(len(b) AS INT) AS stage_id, t - coalesce(list_max(b), 0) AS since_last_cp, coalesce(list_min(a), 83) - t AS until_next_cp, CAST(least(coalesce(t - list_max(b), 1073741824), coalesce(list_min(a) - t, 1073741824)) <= 1 AS INT) AS near_cpd FROM x""")
def _(t):
    cps = t.change_points.where("profile = 'strict'").groupBy("site_id").agg(F.sort_array(F.collect_set("t")).alias("cps"))
    d = cps.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(82).cast("long"))))
    return d.select("site_id", "t", *[x.alias(n) for n, x in p.stage_columns(F.col("t"), F.col("cps"), F.lit(83)).items()])


_STAGES = f"{_CPS}, stg AS (SELECT s.site_id, m.range AS t, len(list_filter(cps, lambda q: q <= m.range)) AS stage_id FROM cpl s, range(83) m)"


@query("a14_stage_kinematics", f"""WITH {_STAGES}, d AS (SELECT p.*, stage_id, disp - lag(disp) OVER (PARTITION BY p.site_id, node_index, stage_id ORDER BY p.t) AS step FROM panel p JOIN stg s ON s.site_id = p.site_id AND s.t = p.t),
per AS (SELECT site_id, node_index, stage_id, arg_max(disp, t) - arg_min(disp, t) AS total, avg(step) AS step, count(*) AS n, min(date) AS f, max(date) AS l FROM d GROUP BY 1, 2, 3)
SELECT site_id, CAST(stage_id AS INT) AS stage_id, max(n) AS length, min(f) AS first_date, max(l) AS last_date, round(avg(total), 6) AS mean_total, round(avg(step), 6) AS mean_step FROM per GROUP BY 1, 2""")
def _(t):
    cps = t.change_points.where("profile = 'strict'").groupBy("site_id").agg(F.sort_array(F.collect_set("t")).alias("cps"))
    d = cps.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(82).cast("long"))))
    return p.stage_kinematics(t.panel, d.select("site_id", "t", p.stage_columns(F.col("t"), F.col("cps"), F.lit(83))["stage_id"].alias("stage_id")))


@query("a10_stage_histogram", f"WITH {_STAGES} SELECT s.split, CAST(stage_id AS INT) AS stage_id, count(*) AS n FROM samples s JOIN stg g ON g.site_id = s.site_id AND g.t = s.start + 16 GROUP BY 1, 2")
def _(t):
    """M5: the stage at the last target of a sample."""
    cps = t.change_points.where("profile = 'strict'").groupBy("site_id").agg(F.sort_array(F.collect_set("t")).alias("cps"))
    d = t.samples.join(cps, "site_id").withColumn("stage_id", F.size(F.filter("cps", lambda x: x <= F.col("start") + 16)))
    return d.groupBy("split", "stage_id").agg(F.count("*").alias("n"))


_SIG = f"""{_TOP}, sg0 AS (SELECT p.site_id, p.t, avg(disp) AS mean, stddev_pop(disp) AS std, avg(disp) FILTER (WHERE top.node_index IS NOT NULL) AS top FROM panel p LEFT JOIN top ON top.site_id = p.site_id AND top.node_index = p.node_index GROUP BY 1, 2),
sig AS MATERIALIZED (SELECT site_id, t, {", ".join(f"({n} - avg({n}) OVER (PARTITION BY site_id)) / (stddev_pop({n}) OVER (PARTITION BY site_id) + 1e-6) AS {n}" for n in ("mean", "std", "top"))} FROM sg0)"""


@query("c1_cpd_signal", f"WITH {_SIG} SELECT site_id, t, round(mean, 6) AS mean, round(std, 6) AS std, round(top, 6) AS top, round((mean + std + top) / 3, 6) AS mix FROM sig")
def _(t):
    return p.cpd_signal(t.panel)


@query("c2_first_split", f"""WITH s AS (SELECT site_id, node_index, t, sum(q) OVER (w ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER w AS i, sum(q) OVER (PARTITION BY site_id, node_index) AS ss, count(*) OVER (PARTITION BY site_id, node_index) AS n FROM panel WINDOW w AS {_W}),
g AS (SELECT site_id, node_index, t + 1 AS t, s * s / i + (ss - s) * (ss - s) / (n - i) - ss * ss / n AS gain FROM s WHERE i >= 5 AND n - i >= 5)
SELECT site_id, node_index, arg_max(t, struct_pack(a := round(gain, 6), b := t)) AS t, round(max(gain), 6) AS gain FROM g GROUP BY 1, 2""")
def _(t):
    """One round of binary segmentation over all series."""
    return p.best_split(t.panel, ["site_id", "node_index"], "q", 5)


def _binary_sql(breaks: int = 4, least: int = 5, jump: int = 5) -> str:
    """One round after the other: the best cut of each series' segments."""
    key, ctes = "site_id, node_index", ["g0 AS (SELECT site_id, node_index, t, q, CAST(0 AS BIGINT) AS seg FROM panel)"]
    for k in range(breaks):
        ctes += [
            f"s{k} AS (SELECT {key}, seg, t, sum(q) OVER w AS s, row_number() OVER w AS i, sum(q) OVER (PARTITION BY {key}, seg) AS ss, count(*) OVER (PARTITION BY {key}, seg) AS n FROM g{k} WINDOW w AS (PARTITION BY {key}, seg ORDER BY t))",
            f"c{k} AS (SELECT {key}, seg, t + 1 AS t, s * s / i + (ss - s) * (ss - s) / (n - i) - ss * ss / n AS gain FROM s{k} WHERE i >= {least} AND n - i >= {least} AND (t + 1) % {jump} = 0)",
            f"b{k} AS (SELECT {key}, seg, arg_max(t, struct_pack(a := round(gain, 6), b := t)) AS t, max(gain) AS gain FROM c{k} GROUP BY {key}, seg HAVING round(max(gain), 9) > 0)",
            f"o{k} AS MATERIALIZED (SELECT {key}, arg_max(struct_pack(seg := seg, t := t), struct_pack(a := round(gain, 6), b := t)) AS x FROM b{k} GROUP BY {key})",
            f"g{k + 1} AS MATERIALIZED (SELECT g.site_id, g.node_index, g.t, q, CASE WHEN g.seg = x.seg AND g.t >= x.t THEN x.t ELSE g.seg END AS seg FROM g{k} g LEFT JOIN o{k} o ON o.site_id = g.site_id AND o.node_index = g.node_index)",
        ]
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT {key}, x.t AS t FROM o{k}" for k in range(breaks))


@query("c2_binary_segmentation", _binary_sql())
def _(t):
    """Four breaks of each node's monthly change, all series at once."""
    return p.binary_segmentation(t.panel, ["site_id", "node_index"], "q", 4)


@query("c4_mean_shift", f"""SELECT site_id, node_index, t, round(abs(a - b) / (sqrt((va + vb) / 2) + 1e-6), 6) AS score FROM (SELECT site_id, node_index, t, avg(q) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS a, avg(q) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS b,
var_pop(q) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS va, var_pop(q) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS vb, least(count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) AS n FROM panel WINDOW w AS {_W})
WHERE n = 6 AND va + vb > 0.001""")
def _(t):
    w = p.by_time()
    d = t.panel.withColumn("flat", F.var_pop("q").over(w.rowsBetween(-6, -1)) + F.var_pop("q").over(w.rowsBetween(0, 5)))
    return p.mean_shift(d, ["site_id", "node_index"], "q").join(d.where("flat > 0.001").select("site_id", "node_index", "t"), ["site_id", "node_index", "t"])


@query("c4_spaced_shifts")
def _(t):
    return p.spaced(p.mean_shift(t.panel, ["site_id", "node_index"], "q"), ["site_id", "node_index"], 6)


@query("c5_exact_segmentation")
def _(t):
    """Exact cuts of each site's mean signal, a task for each series."""
    return p.solve_series(p.cpd_signal(t.panel), ["site_id"], "mean", "exact")


@query("c8_method_sensitivity")
def _(t):
    """Change points of each site's mean signal by six methods, with their number and places."""
    s = c.cut(p.cpd_signal(t.panel).select("site_id", "t", "mean"))
    found = p.solve_series(s, ["site_id"], "mean", "exact").union(p.solve_series(s, ["site_id"], "mean", "window")).union(p.solve_series(s, ["site_id"], "mean", "kernel")).union(p.solve_series(s, ["site_id"], "mean", "penalised", penalty=2.0)).union(p.solve_series(s, ["site_id"], "mean", "bottom_up"))
    found = found.union(p.binary_segmentation(s, ["site_id"], "mean", 3).select("site_id", F.lit("binary"), "t"))
    return found.groupBy("site_id", "method").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list("t")), lambda x: x.cast("string"))).alias("places"))


@query("c6_quantile_fallback", """WITH cp AS (SELECT DISTINCT site_id, t FROM change_points WHERE profile = 'strict')
SELECT site_id, t FROM cp UNION ALL SELECT site_id, CAST(floor(83 * q) AS BIGINT) AS t FROM sites, (VALUES (0.25), (0.5), (0.75)) v(q) WHERE site_id NOT IN (SELECT site_id FROM cp)""")
def _(t):
    cp = t.change_points.where("profile = 'strict'").select("site_id", "t").distinct()
    series = t.panel.select("site_id", "t").distinct()
    return p.quantile_fallback(cp, series, ["site_id"])


@query("w16_cpd_density", """WITH e AS (SELECT DISTINCT site_id, node_index, t + d AS t FROM change_points, (VALUES (-1), (0), (1)) v(d) WHERE profile = 'strict' AND t + d BETWEEN 0 AND 82)
SELECT p.site_id, p.t, round(count(e.t) / 12.0, 6) AS density FROM panel p LEFT JOIN e ON e.site_id = p.site_id AND e.node_index = p.node_index AND e.t = p.t GROUP BY 1, 2""")
def _(t):
    e = t.change_points.where("profile = 'strict'").withColumn("t", F.explode(F.sequence(F.col("t") - 1, F.col("t") + 1))).where("t between 0 and 82").select("site_id", "node_index", "t").distinct().withColumn("hit", F.lit(1))
    d = t.panel.join(e, ["site_id", "node_index", "t"], "left").groupBy("site_id", "t").agg((F.count("hit") / 12.0).alias("density"))
    return d


@query("a12_plane_azimuth", """WITH c AS (SELECT *, avg(lat) OVER (PARTITION BY site_id) AS la, avg(lon) OVER (PARTITION BY site_id) AS lo FROM nodes), x AS (SELECT *, (lon - lo) * 111320.0 * cos(radians(la)) AS x, (lat - la) * 110540.0 AS y FROM c),
g AS (SELECT site_id, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, elevation) AS xz, covar_pop(y, elevation) AS yz FROM x GROUP BY 1),
ab AS (SELECT site_id, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM g)
SELECT site_id, round(CASE WHEN degrees(atan2(-a, -b)) < 0 THEN degrees(atan2(-a, -b)) + 360 ELSE degrees(atan2(-a, -b)) END, 4) AS azimuth, round(degrees(atan(sqrt(a * a + b * b))), 4) AS slope FROM ab""")
def _(t):
    return p.plane_azimuth(t.nodes, ["site_id"]).select("site_id", F.round("azimuth", 4).alias("azimuth"), F.round("slope", 4).alias("slope"))


@query("a13_group_summary", f"WITH {_MOTION} SELECT n.site_id, count(*) AS nodes, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, round(avg(elevation), 6) AS elevation_mean, round(avg(total_change), 6) AS change_mean, round(avg(rain_susceptibility), 6) AS susceptibility_mean FROM nodes n JOIN mot m ON m.site_id = n.site_id AND m.node_index = n.node_index JOIN susceptibility s ON s.site_id = n.site_id AND s.node_index = n.node_index GROUP BY 1")
def _(t):
    return p.group_summary(t.nodes, t.panel, t.susceptibility, ["site_id"])


_KNN = "knn AS MATERIALIZED (SELECT * FROM (SELECT a.site_id, a.node_index AS src, b.node_index AS dst, a.elevation AS h0, b.elevation AS h1, (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) AS d2, row_number() OVER (PARTITION BY a.site_id, a.node_index ORDER BY round((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat), 12), b.node_index) AS rank FROM nodes a JOIN nodes b ON a.site_id = b.site_id AND a.node_index <> b.node_index) WHERE rank <= 4)"
_EDGES = f"""{_KNN}, ew AS (SELECT *, exp(-d2 / (2 * sd * sd)) * exp(-(h0 - h1) * (h0 - h1) / (2 * sh * sh)) * CASE WHEN h1 > h0 THEN 0.35 ELSE 1 END AS raw FROM knn JOIN (SELECT site_id AS s, quantile_cont(sqrt(d2), 0.5) FILTER (WHERE d2 > 0) AS sd, quantile_cont(abs(h0 - h1), 0.5) FILTER (WHERE h0 <> h1) AS sh FROM knn GROUP BY 1) q ON q.s = site_id),
ek AS (SELECT site_id, src, dst, CASE WHEN has THEN raw ELSE 0.25 END AS w FROM (SELECT *, bool_or(raw >= 0.23) OVER (PARTITION BY site_id, src) AS has FROM ew) WHERE raw >= 0.23 OR (NOT has AND rank = 1) UNION ALL SELECT site_id, node_index, node_index, 1.0 FROM nodes),
edges AS MATERIALIZED (SELECT site_id, src, dst, w / sum(w) OVER (PARTITION BY site_id, src) AS weight FROM ek)"""


@query("j13_nearest_nodes", f"WITH {_KNN} SELECT site_id, src, dst, CAST(rank AS INT) AS rank FROM knn")
def _(t):
    return p.nearest_nodes(t.nodes).select("site_id", "src", "dst", "rank")


@query("g1_terrain_edges", f"WITH {_EDGES} SELECT site_id, src, dst, round(weight, 6) AS weight FROM edges")
def _(t):
    return p.terrain_edges(t.nodes)


@query("g2_flow_weight", f"WITH {_EDGES}, f AS (SELECT e.site_id, src AS node_index, sum(weight * greatest(a.elevation - b.elevation, 0)) AS flow FROM edges e JOIN nodes a ON a.site_id = e.site_id AND a.node_index = src JOIN nodes b ON b.site_id = e.site_id AND b.node_index = dst GROUP BY 1, 2) SELECT site_id, node_index, round(0.5 + 0.5 * CASE WHEN max(flow) OVER w - min(flow) OVER w < 1e-6 THEN 0 ELSE (flow - min(flow) OVER w) / (max(flow) OVER w - min(flow) OVER w) END, 6) AS flow_weight FROM f WINDOW w AS (PARTITION BY site_id)")
def _(t):
    return p.flow_weight(c.cut(p.terrain_edges(t.nodes)), t.nodes)


@query("g3_graph_smooth", f"WITH {_EDGES} SELECT p.site_id, p.node_index, p.t, round(0.95 * any_value(p.disp) + 0.05 * sum(weight * v.disp) / sum(weight), 6) AS smooth FROM panel p JOIN edges e ON e.site_id = p.site_id AND e.src = p.node_index JOIN panel v ON v.site_id = p.site_id AND v.node_index = e.dst AND v.t = p.t GROUP BY 1, 2, 3")
def _(t):
    return p.graph_smooth(t.panel.select("site_id", "node_index", "t", "disp"), p.terrain_edges(t.nodes), ["t"], "disp").drop("disp")


@query("g4_normalised_laplacian", f"WITH {_EDGES}, s AS (SELECT site_id, src, dst, max(weight) AS w FROM (SELECT site_id, src, dst, weight FROM edges UNION ALL SELECT site_id, dst, src, weight FROM edges) GROUP BY 1, 2, 3), g AS (SELECT site_id, src AS n, sum(w) AS g FROM s GROUP BY 1, 2) SELECT s.site_id, src, dst, round(CASE WHEN src = dst THEN 1 ELSE 0 END - w / sqrt(a.g * b.g), 6) AS value FROM s JOIN g a ON a.site_id = s.site_id AND a.n = src JOIN g b ON b.site_id = s.site_id AND b.n = dst")
def _(t):
    return p.normalised_laplacian(c.cut(p.terrain_edges(t.nodes)))


_SYM = "sy0 AS (SELECT site_id, src, dst, sum(weight / 2) AS w FROM (SELECT site_id, src, dst, weight FROM edges UNION ALL SELECT site_id, dst, src, weight FROM edges) GROUP BY 1, 2, 3), sy AS (SELECT site_id, src, dst, CASE WHEN max(w) OVER (PARTITION BY site_id) > 0 THEN w / max(w) OVER (PARTITION BY site_id) ELSE w END AS w FROM sy0)"


@query("g4_renormalised_adjacency", f"WITH {_EDGES}, {_SYM}, a AS (SELECT site_id, src, dst, sum(w) AS a FROM (SELECT site_id, src, dst, w FROM sy UNION ALL SELECT site_id, node_index, node_index, 1.0 FROM nodes) GROUP BY 1, 2, 3), d AS (SELECT site_id, src, sum(a) AS d FROM a GROUP BY 1, 2) SELECT a.site_id, a.src, a.dst, round(CASE WHEN a.src = a.dst THEN 1 ELSE 0 END + a / sqrt(d.d * e.d), 6) AS value FROM a JOIN d ON d.site_id = a.site_id AND d.src = a.src JOIN d e ON e.site_id = a.site_id AND e.src = a.dst")
def _(t):
    return p.renormalised_adjacency(c.cut(p.symmetric_scaled(c.cut(p.terrain_edges(t.nodes)))), t.nodes)


@query("g4_chebyshev")
def _(t):
    """Three Chebyshev polynomials of the scaled Laplacian, applied to the last displacements."""
    w = c.cut(p.symmetric_scaled(c.cut(p.terrain_edges(t.nodes))))
    last = t.panel.groupBy("site_id", "node_index").agg(F.max_by("disp", "t").alias("x"))
    return p.chebyshev(c.cut(p.scaled_laplacian(w, t.nodes)), c.cut(last), 3)


@query("p1_bounding_box", "SELECT site_id, round(min(lon) - 0.01, 6) AS west, round(max(lon) + 0.01, 6) AS east, round(min(lat) - 0.01, 6) AS south, round(max(lat) + 0.01, 6) AS north FROM nodes GROUP BY 1")
def _(t):
    return t.nodes.groupBy("site_id").agg((F.min("lon") - 0.01).alias("west"), (F.max("lon") + 0.01).alias("east"), (F.min("lat") - 0.01).alias("south"), (F.max("lat") + 0.01).alias("north"))


@query("p2_raster_window", "SELECT site_id, CAST(floor((min(lon) - 0.01 + 180) / 0.05) AS BIGINT) AS col_lo, CAST(floor((max(lon) + 0.01 + 180) / 0.05) AS BIGINT) AS col_hi, CAST(floor((50 - max(lat) - 0.01) / 0.05) AS BIGINT) AS row_lo, CAST(floor((50 - min(lat) + 0.01) / 0.05) AS BIGINT) AS row_hi FROM nodes GROUP BY 1")
def _(t):
    """A window of 0.05 degree cells, from 180 W and 50 N."""
    x = lambda v: F.floor((v + 180) / 0.05)
    y = lambda v: F.floor((50 - v) / 0.05)
    return t.nodes.groupBy("site_id").agg(x(F.min("lon") - 0.01).alias("col_lo"), x(F.max("lon") + 0.01).alias("col_hi"), F.floor((50 - F.max("lat") - 0.01) / 0.05).alias("row_lo"), F.floor((50 - F.min("lat") + 0.01) / 0.05).alias("row_hi"))


@query("a28_common_box", "SELECT round(max(w), 6) AS west, round(min(e), 6) AS east, round(max(s), 6) AS south, round(min(n), 6) AS north FROM (SELECT site_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM nodes GROUP BY 1)")
def _(t):
    b = t.nodes.groupBy("site_id").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    return b.agg(F.max("w").alias("west"), F.min("e").alias("east"), F.max("s").alias("south"), F.min("n").alias("north"))


@query("p7_sparsified_hotspots", "SELECT s.site_id, node_index, round(CASE WHEN cut IS NULL OR hi - cut < 1e-6 THEN rain_susceptibility_dense ELSE greatest(0, least(1, (rain_susceptibility_dense - cut) / (hi - cut))) END, 6) AS hotspot FROM susceptibility s JOIN (SELECT site_id, quantile_cont(rain_susceptibility_dense, 0.75) FILTER (WHERE rain_susceptibility_dense > 0) AS cut, max(rain_susceptibility_dense) AS hi FROM susceptibility GROUP BY 1) q ON q.site_id = s.site_id")
def _(t):
    return c.sparsify(t.susceptibility, ["site_id"], "rain_susceptibility_dense", "hotspot").select("site_id", "node_index", "hotspot")
