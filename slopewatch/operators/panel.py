"""The displacement panel: series features, windows, stages, change points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.common import cut, min_max, with_stats

NODE = ["site_id", "node_index"]


def by_time() -> Window:
    return Window.partitionBy(*NODE).orderBy("t")


def long_panel(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """A row for each acquisition of a wide table: t is the column's place, date its name without a `.1` suffix."""
    names = [c for c in wide.columns if c not in ids]
    if len(names) < 20:
        raise ValueError(f"a panel needs 20 acquisitions; {len(names)} columns are left besides {list(ids)}")
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    d = wide.unpivot(list(ids), [f"`{n}`" for n in names], "label", "disp")
    return d.select(*ids, place[F.col("label")].cast("long").alias("t"), F.to_date(F.regexp_replace("label", r"\.\d+$", "")).alias("date"), F.when(~F.isnan("disp"), F.col("disp")).alias("disp"))


def transposed(panel: DataFrame, nodes: Sequence[int]) -> DataFrame:
    """A column for each node, a row for each site and time."""
    return panel.groupBy("site_id", "t").pivot("node_index", list(nodes)).agg(F.first("disp"))


def increments(panel: DataFrame) -> DataFrame:
    """signed, absolute and second differences of each node."""
    d = panel.withColumn("signed", F.col("disp") - F.lag("disp").over(by_time()))
    return d.withColumn("absolute", F.abs("signed")).withColumn("second", F.col("signed") - F.lag("signed").over(by_time()))


def group_increments(panel: DataFrame) -> DataFrame:
    """Mean increments of a site at each time, and the change of the mean; 0 at the first."""
    d = increments(panel).where("signed is not null").groupBy("site_id", "t").agg(F.avg("signed").alias("signed"), F.avg("absolute").alias("absolute"))
    w = Window.partitionBy("site_id").orderBy("t")
    return d.withColumn("change", F.coalesce(F.col("signed") - F.lag("signed").over(w), F.lit(0.0)))


def decomposed(d: DataFrame, by: Sequence[str], value: str, long: int = 12, short: int = 3) -> DataFrame:
    """Trailing means over long and short windows (partial at the start), the disturbance around the first, the shock around the second."""
    w = Window.partitionBy(*by).orderBy("t")
    d = d.withColumn("long_trend", F.avg(value).over(w.rowsBetween(-(long - 1), 0))).withColumn("short_baseline", F.avg(value).over(w.rowsBetween(-(short - 1), 0)))
    return d.withColumn("rain_disturbance", F.col(value) - F.col("long_trend")).withColumn("short_shock", F.col(value) - F.col("short_baseline"))


def motion(panel: DataFrame) -> DataFrame:
    """Population deviation of the steps and the total change of each node."""
    return increments(panel).groupBy(*NODE).agg(F.stddev_pop("signed").alias("motion_std"), (F.max_by("disp", "t") - F.min_by("disp", "t")).alias("total_change"))


def top_moving(panel: DataFrame, ratio: float = 0.1) -> DataFrame:
    """The max(1, floor(n * ratio)) nodes of a site with the largest motion deviation; ties to the smaller node."""
    w = Window.partitionBy("site_id")
    d = motion(panel).withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("motion_std", 9)), "node_index"))).withColumn("_n", F.count("*").over(w))
    return d.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).drop("_n")


def sample_windows(panel: DataFrame, n_his: int, n_pred: int) -> DataFrame:
    """(site_id, node_index, start, history, target): every window of n_his + n_pred observations."""
    n = n_his + n_pred
    d = panel.select(*NODE, F.col("t").alias("start"), F.collect_list("disp").over(by_time().rowsBetween(0, n - 1)).alias("w")).where(F.size("w") == n)
    return d.select(*NODE, "start", F.slice("w", 1, n_his).alias("history"), F.slice("w", n_his + 1, n_pred).alias("target"))


def stage_columns(t: Column, cps: Column, end: Column) -> dict[str, Column]:
    """Stage of a time given sorted change points, and its distance to those before and after."""
    before, after = F.array_max(F.filter(cps, lambda x: x <= t)), F.array_min(F.filter(cps, lambda x: x > t))
    since, until = t - F.coalesce(before, F.lit(0)), F.coalesce(after, end) - t
    nearest = F.least(F.coalesce(t - before, F.lit(1 << 30)), F.coalesce(after - t, F.lit(1 << 30)))
    return {"stage_id": F.size(F.filter(cps, lambda x: x <= t)), "since_last_cp": since, "until_next_cp": until, "near_cpd": (nearest <= 1).cast("int")}


def cpd_signal(panel: DataFrame) -> DataFrame:
    """Mean, spread, top-node and mixed signals of each site, as z-scores with the deviation + 1e-6."""
    top = top_moving(panel).select(*NODE, F.lit(1).alias("_top"))
    d = panel.join(top, NODE, "left").groupBy("site_id", "t").agg(F.avg("disp").alias("mean"), F.stddev_pop("disp").alias("std"), F.avg(F.when(F.col("_top") == 1, F.col("disp"))).alias("top"))
    names = ["mean", "std", "top"]
    d = with_stats(d, ["site_id"], **{f"_m{n}": F.avg(n) for n in names}, **{f"_s{n}": F.stddev_pop(n) for n in names})
    d = d.select("site_id", "t", *[((F.col(n) - F.col(f"_m{n}")) / (F.col(f"_s{n}") + 1e-6)).alias(n) for n in names])
    return d.withColumn("mix", (F.col("mean") + F.col("std") + F.col("top")) / 3)


def best_split(d: DataFrame, by: Sequence[str], value: str, least: int, jump: int = 1) -> DataFrame:
    """For each series (by) the split with the largest drop of the squared error: (by, t, gain). d: by, t (0-based, dense), value.

    t is the first position after the split; both parts have at least `least` values. Ties go to the later position.
    """
    w = Window.partitionBy(*by).orderBy("t")
    whole = Window.partitionBy(*by)
    p = d.select(*by, "t", F.sum(value).over(w).alias("upto"), F.row_number().over(w).alias("i"), F.sum(value).over(whole).alias("total"), F.count("*").over(whole).alias("n"))
    gain = F.col("upto") ** 2 / F.col("i") + (F.col("total") - F.col("upto")) ** 2 / (F.col("n") - F.col("i")) - F.col("total") ** 2 / F.col("n")
    ok = (F.col("i") >= least) & (F.col("n") - F.col("i") >= least) & ((F.col("t") + 1) % jump == 0)
    return p.where(ok).select(*by, (F.col("t") + 1).alias("t"), gain.alias("gain")).groupBy(*by).agg(F.max_by("t", F.struct(F.round("gain", 6), "t")).alias("t"), F.max("gain").alias("gain"))


def binary_segmentation(d: DataFrame, by: Sequence[str], value: str, breaks: int, least: int = 5, jump: int = 5) -> DataFrame:
    """(by, t): up to `breaks` change points of each series, one more in each round where the squared error drops most.

    All series are cut at once; a round is one aggregation over (series, segment, position). Bounded rounds; the
    segments are kept between rounds, so the lineage doesn't grow.
    """
    found = None
    d = cut(d.select(*by, "t", F.col(value).alias("_v"), F.lit(0).cast("long").alias("_segment")))
    for _ in range(breaks):
        per = best_split(d, [*by, "_segment"], "_v", least, jump).where(F.round("gain", 9) > 0)
        one = per.groupBy(*by).agg(F.max_by(F.struct("_segment", "t"), F.struct(F.round("gain", 6), "t")).alias("x")).select(*by, F.col("x._segment").alias("_cut"), F.col("x.t").alias("_at"))
        one = cut(one)
        found = one if found is None else found.union(one)
        d = cut(d.join(one, list(by), "left").withColumn("_segment", F.when((F.col("_segment") == F.col("_cut")) & (F.col("t") >= F.col("_at")), F.col("_at")).otherwise(F.col("_segment"))).drop("_cut", "_at"))
    return found.select(*by, F.col("_at").alias("t"))


def mean_shift(d: DataFrame, by: Sequence[str], value: str, width: int = 6) -> DataFrame:
    """(by, t, score): difference of the means of the windows before and after t over their pooled deviation."""
    w = Window.partitionBy(*by).orderBy("t")
    left, right = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    a, b = F.avg(value).over(left), F.avg(value).over(right)
    pooled = F.sqrt((F.var_pop(value).over(left) + F.var_pop(value).over(right)) / 2)
    n = F.least(F.count("*").over(left), F.count("*").over(right))
    return d.select(*by, "t", F.when(n == width, F.abs(a - b) / (pooled + 1e-6)).alias("score")).where("score is not null")


def spaced(scores: DataFrame, by: Sequence[str], gap: int, q: float = 0.75) -> DataFrame:
    """Times above the q-quantile of a series' scores, best first, none within `gap` of a better one."""
    d = with_stats(scores, by, _q=F.percentile("score", F.lit(q))).where("score >= _q")
    r = d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("a"), "t"))).alias("r"))
    kept = F.aggregate("r", F.array().cast("array<long>"), lambda acc, x: F.when(F.exists(acc, lambda k: F.abs(k - x["t"]) < gap), acc).otherwise(F.concat(acc, F.array(x["t"]))))
    return r.select(*by, F.explode(kept).alias("t"))


def quantile_fallback(change_points: DataFrame, series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Change points; series without any get the quarters of their length."""
    have = change_points.select(*by).distinct()
    none = series.groupBy(*by).agg(F.count("*").alias("n")).join(have, list(by), "left_anti")
    quarters = F.array(*[F.floor(F.col("n") * q).cast("long") for q in (0.25, 0.5, 0.75)])
    return change_points.select(*by, "t").union(none.select(*by, F.explode(quarters).alias("t")))


def exact_breaks(x: np.ndarray, breaks: int, least: int) -> list[int]:
    """The cuts of one series with the least squared error, by dynamic programming."""
    s, ss = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    return least_cost_breaks(len(x), lambda a, b: ss[b] - ss[a] - (s[b] - s[a]) ** 2 / (b - a), breaks, least)


def kernel_breaks(x: np.ndarray, breaks: int, least: int) -> list[int]:
    """The cuts of one series with the least spread in the space of a Gaussian kernel, whose width is the median distance."""
    far = (x[:, None] - x[None, :]) ** 2
    usual = np.median(far[far > 0]) if (far > 0).any() else 1.0
    upto = np.zeros((len(x) + 1, len(x) + 1))
    upto[1:, 1:] = np.exp(-far / usual).cumsum(axis=0).cumsum(axis=1)
    return least_cost_breaks(len(x), lambda a, b: (b - a) - (upto[b, b] - upto[a, b] - upto[b, a] + upto[a, a]) / (b - a), breaks, least)


def window_breaks(x: np.ndarray, breaks: int, least: int) -> list[int]:
    """Where the two halves of a sliding window differ most: the highest peaks that are `least` apart, the earlier one of equal ones."""
    half = max(2 * least, min(40, len(x) // 4)) // 2
    s, ss = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = lambda a, b: ss[b] - ss[a] - (s[b] - s[a]) ** 2 / (b - a)
    at = np.arange(half, len(x) - half + 1)
    gain = cost(at - half, at + half) - cost(at - half, at) - cost(at, at + half) if len(at) else np.zeros(0)
    out: list[int] = []
    for i in np.argsort(-gain, kind="stable").tolist():
        if len(out) == breaks:
            break
        if all(abs(int(at[i]) - b) >= least for b in out):
            out.append(int(at[i]))
    return sorted(out)


def least_cost_breaks(n: int, cost, breaks: int, least: int) -> list[int]:
    """The cuts of a series of n values with the least sum of cost(a, b) over its pieces [a, b); a may be an array."""
    best = np.full((breaks + 1, n + 1), np.inf)
    back = np.zeros((breaks + 1, n + 1), np.int64)
    for e in range(least, n + 1):
        best[0, e] = cost(0, e)
    for k in range(1, breaks + 1):
        for e in range((k + 1) * least, n + 1):
            a = np.arange(k * least, e - least + 1)
            v = best[k - 1, a] + cost(a, e)
            back[k, e], best[k, e] = a[v.argmin()], v.min()
    out, e = [], n
    for k in range(breaks, 0, -1):
        if not np.isfinite(best[k, e]):
            return []
        e = int(back[k, e])
        out.append(e)
    return out[::-1]


def penalised_breaks(x: np.ndarray, penalty: float, least: int) -> list[int]:
    """Cuts with the least squared error plus a penalty each, by pruned dynamic programming."""
    n, s, ss = len(x), np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    total, last, starts = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), [0]
    total[0] = -penalty
    for e in range(least, n + 1):
        a = np.array([i for i in starts if e - i >= least])
        if not len(a):
            continue
        v = total[a] + ss[e] - ss[a] - (s[e] - s[a]) ** 2 / (e - a)
        total[e], last[e] = v.min() + penalty, a[v.argmin()]
        keep = set(a[v <= total[e]].tolist())
        starts = [i for i in starts if e - i < least or i in keep] + [e]
    out, e = [], n
    while last[e] > 0:
        e = int(last[e])
        out.append(e)
    return out[::-1]


def bottom_up_breaks(x: np.ndarray, breaks: int, least: int) -> list[int]:
    """Cuts that are left when neighbouring pieces of `least` values are merged, cheapest first, down to breaks + 1 pieces."""
    edges = list(range(0, len(x) - least + 1, least)) + [len(x)]
    s, ss = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = lambda a, b: ss[b] - ss[a] - (s[b] - s[a]) ** 2 / (b - a)
    while len(edges) > breaks + 2:
        gains = [cost(a, c) - cost(a, b) - cost(b, c) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)]
        edges.pop(int(np.argmin(gains)) + 1)
    return edges[1:-1]


def solve_series(d: DataFrame, by: Sequence[str], value: str, method: str, breaks: int = 3, least: int = 5, penalty: float = 10.0) -> DataFrame:
    """(by, method, t): change points of each series by exact, penalised, bottom_up, window or kernel; a task for each series, in order of t."""
    keys = list(by)
    types = dict(d.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", method string, t long"
    cuts = {"exact": exact_breaks, "bottom_up": bottom_up_breaks, "window": window_breaks, "kernel": kernel_breaks}
    solver = (lambda x: penalised_breaks(x, penalty, least)) if method == "penalised" else lambda x: cuts[method](x, breaks, least)

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        at = solver(pdf[value].to_numpy(float))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(at) for k in keys}, "method": method, "t": at})

    return d.groupBy(*keys).applyInPandas(task, schema)


def stage_kinematics(panel: DataFrame, stages: DataFrame) -> DataFrame:
    """Length, dates, mean total change and mean step of each stage; steps across stages don't count. stages: site_id, t, stage_id."""
    d = panel.join(stages, ["site_id", "t"])
    w = Window.partitionBy(*NODE, "stage_id").orderBy("t")
    d = d.withColumn("_step", F.col("disp") - F.lag("disp").over(w))
    per = d.groupBy(*NODE, "stage_id").agg((F.max_by("disp", "t") - F.min_by("disp", "t")).alias("total"), F.avg("_step").alias("step"), F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    return per.groupBy("site_id", "stage_id").agg(F.max("n").alias("length"), F.min("first").alias("first_date"), F.max("last").alias("last_date"), F.avg("total").alias("mean_total"), F.avg("step").alias("mean_step"))


def plane_azimuth(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Downslope azimuth in degrees of a least-squares plane of elevation over local east and north coordinates, in metres."""
    d = with_stats(nodes, by, _lat=F.avg("lat"), _lon=F.avg("lon"))
    d = d.withColumn("x", (F.col("lon") - F.col("_lon")) * 111320.0 * F.cos(F.radians("_lat"))).withColumn("y", (F.col("lat") - F.col("_lat")) * 110540.0)
    g = d.groupBy(*by).agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "elevation").alias("xz"), F.covar_pop("y", "elevation").alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") ** 2
    a, b = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    return g.select(*by, F.when(F.abs(det) > 1e-9, F.pmod(F.degrees(F.atan2(-a, -b)), F.lit(360.0))).alias("azimuth"), F.when(F.abs(det) > 1e-9, F.degrees(F.atan(F.sqrt(a * a + b * b)))).alias("slope"))


def group_summary(nodes: DataFrame, panel: DataFrame, susceptibility: DataFrame, by: Sequence[str]) -> DataFrame:
    d = nodes.join(motion(panel), NODE).join(susceptibility, NODE, "left")
    return d.groupBy(*by).agg(F.count("*").alias("nodes"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.avg("elevation").alias("elevation_mean"), F.avg("total_change").alias("change_mean"), F.avg("rain_susceptibility").alias("susceptibility_mean"))


def nearest_nodes(nodes: DataFrame, k: int = 4, cell: float = 0.005) -> DataFrame:
    """(site_id, src, dst, d2, rank): the k nearest other nodes of the site, ties to the smaller index.

    Nodes meet those within two rings of grid cells, and are done once k of them lie within two cells' length. The
    others go on in cells of twice the size, level by level, until all are done or two cells' length spans every site;
    so a node meets as many others as its surroundings ask for, never all of its site at once.
    """
    n = cut(nodes.select("site_id", "node_index", "lon", "lat"))
    span = n.groupBy("site_id").agg(F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")).alias("s")).agg(F.max("s")).first()[0] or 0.0
    w = Window.partitionBy("site_id", "src").orderBy(F.round("d2", 12), "dst")
    d2 = ((F.col("lon") - F.col("lon2")) ** 2 + (F.col("lat") - F.col("lat2")) ** 2).alias("d2")
    todo, found, size = n.withColumnRenamed("node_index", "src"), None, cell
    while True:
        place = lambda c, size=size: F.floor(F.col(c) / size)
        right = n.select("site_id", F.col("node_index").alias("dst"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), place("lon").alias("cx"), place("lat").alias("cy"))
        ring = F.sequence(F.lit(-2), F.lit(2))
        left = todo.withColumn("dx", F.explode(ring)).withColumn("dy", F.explode(ring))
        left = left.select("site_id", "src", "lon", "lat", (place("lon") + F.col("dx")).alias("cx"), (place("lat") + F.col("dy")).alias("cy"))
        near = left.join(right, ["site_id", "cx", "cy"]).where("src != dst").select("site_id", "src", "dst", d2)
        near = cut(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        if 2 * size >= span:
            return near if found is None else found.unionByName(near)
        good = near.groupBy("site_id", "src").agg(F.count("*").alias("c"), F.max("d2").alias("m")).where((F.col("c") == k) & (F.col("m") <= (2 * size) ** 2)).select("site_id", "src")
        done = near.join(good, ["site_id", "src"], "left_semi")
        found = done if found is None else found.unionByName(done)
        todo = cut(todo.join(good, ["site_id", "src"], "left_anti"))
        if todo.isEmpty():
            return found
        size *= 2


def terrain_edges(nodes: DataFrame, k: int = 4, least: float = 0.23) -> DataFrame:
    """(site_id, src, dst, weight): neighbours by distance, height and direction of slope, with self loops, rows adding up to 1."""
    h = nodes.select("site_id", "node_index", "elevation")
    e = nearest_nodes(nodes, k).join(h.withColumnRenamed("node_index", "src").withColumnRenamed("elevation", "h0"), ["site_id", "src"]).join(h.withColumnRenamed("node_index", "dst").withColumnRenamed("elevation", "h1"), ["site_id", "dst"])
    e = e.withColumn("d", F.sqrt("d2")).withColumn("dh", F.abs(F.col("h0") - F.col("h1")))
    e = with_stats(e, ["site_id"], sd=F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.5)), sh=F.percentile(F.when(F.col("dh") > 0, F.col("dh")), F.lit(0.5)))
    raw = F.exp(-F.col("d2") / (2 * F.col("sd") ** 2)) * F.exp(-(F.col("dh") ** 2) / (2 * F.col("sh") ** 2)) * F.when(F.col("h1") > F.col("h0"), 0.35).otherwise(1.0)
    e = e.withColumn("raw", raw)
    some = F.max((F.col("raw") >= least).cast("int")).over(Window.partitionBy("site_id", "src"))
    e = e.withColumn("some", some).where((F.col("raw") >= least) | (F.col("some") == 0) & (F.col("rank") == 1)).withColumn("w", F.when(F.col("some") == 0, 0.25).otherwise(F.col("raw")))
    loops = nodes.select("site_id", F.col("node_index").alias("src"), F.col("node_index").alias("dst"), F.lit(1.0).alias("w"))
    e = e.select("site_id", "src", "dst", "w").unionByName(loops)
    return e.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("site_id", "src"))).drop("w")


def flow_weight(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site_id, node_index, flow_weight): weighted drops to neighbours, scaled to [0.5, 1] within the site."""
    h = nodes.select("site_id", "node_index", "elevation")
    e = edges.join(h.withColumnRenamed("node_index", "src").withColumnRenamed("elevation", "h0"), ["site_id", "src"]).join(h.withColumnRenamed("node_index", "dst").withColumnRenamed("elevation", "h1"), ["site_id", "dst"])
    g = e.groupBy("site_id", F.col("src").alias("node_index")).agg(F.sum(F.col("weight") * F.greatest(F.col("h0") - F.col("h1"), F.lit(0.0))).alias("flow"))
    return min_max(g, ["site_id"], "flow", "_f").select("site_id", "node_index", (0.5 + 0.5 * F.col("_f")).alias("flow_weight"))


def graph_smooth(values: DataFrame, edges: DataFrame, by: Sequence[str], value: str, strength: float = 0.05) -> DataFrame:
    """value moved by `strength` towards the weighted mean of its neighbours. values: site_id, node_index, by, value."""
    v = values.select("site_id", F.col("node_index").alias("dst"), *by, F.col(value).alias("_v"))
    m = edges.join(v, ["site_id", "dst"]).groupBy("site_id", F.col("src").alias("node_index"), *by).agg((F.sum(F.col("weight") * F.col("_v")) / F.sum("weight")).alias("_m"))
    return values.join(m, ["site_id", "node_index", *by], "left").withColumn("smooth", (1 - strength) * F.col(value) + strength * F.coalesce("_m", value)).drop("_m")


def with_near(panel: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, node_index, t, disp, near): the weighted mean of the neighbours less the node's own value, 0 without neighbours.

    Each value goes to those that have it as a neighbour and to its own node, where they are added up: the panel is read
    once and meets only a row for each node.
    """
    to = edges.groupBy("site_id", F.col("dst").alias("node_index")).agg(F.collect_list(F.struct("src", "weight")).alias("_to"))
    own = F.array(F.struct(F.col("node_index").alias("src"), F.lit(None).cast("double").alias("weight")))
    sent = F.explode(F.when(F.col("_to").isNull(), own).otherwise(F.concat("_to", own)))
    v = panel.select(*NODE, "t", "disp").join(to.hint("merge"), NODE, "left").select("site_id", "t", "disp", sent.alias("_e"))
    w = F.col("_e.weight")
    g = v.groupBy("site_id", F.col("_e.src").alias("node_index"), "t").agg((F.sum(w * F.col("disp")) / F.sum(w)).alias("_m"), F.max(F.when(w.isNull(), F.col("disp"))).alias("disp"), F.max(w.isNull()).alias("_own"))
    return g.where("_own").select(*NODE, "t", "disp", (F.coalesce("_m", "disp") - F.col("disp")).alias("near"))


def normalised_laplacian(edges: DataFrame) -> DataFrame:
    """(site_id, src, dst, value) of I - D^-1/2 W D^-1/2 of the symmetrised weights."""
    s = edges.unionByName(edges.select("site_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("site_id", "src", "dst").agg(F.max("weight").alias("w"))
    deg = s.groupBy("site_id", F.col("src").alias("n")).agg(F.sum("w").alias("g"))
    d = s.join(deg.withColumnRenamed("n", "src").withColumnRenamed("g", "g0"), ["site_id", "src"]).join(deg.withColumnRenamed("n", "dst").withColumnRenamed("g", "g1"), ["site_id", "dst"])
    return d.select("site_id", "src", "dst", (F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0) - F.col("w") / F.sqrt(F.col("g0") * F.col("g1"))).alias("value"))




def symmetric_scaled(edges: DataFrame) -> DataFrame:
    """(site_id, src, dst, weight): the mean of both directions' weights, divided by the site's largest; bad weights count as 0."""
    w = F.when(~F.isnan("weight"), F.col("weight")).otherwise(0.0) / 2
    both = edges.select("site_id", "src", "dst", w.alias("w")).union(edges.select("site_id", "dst", "src", w))
    s = both.groupBy("site_id", "src", "dst").agg(F.sum("w").alias("w"))
    top = s.groupBy("site_id").agg(F.max("w").alias("top"))
    return s.join(top, "site_id").select("site_id", "src", "dst", F.when(F.col("top") > 0, F.col("w") / F.col("top")).otherwise(F.col("w")).alias("weight"))


def renormalised_adjacency(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site_id, src, dst, value) of I + D^-1/2 (W + I) D^-1/2, with D the row sums of W + I. weights: symmetric; nodes: all, linked or not."""
    own = nodes.select("site_id", F.col("node_index").alias("src"), F.col("node_index").alias("dst"), F.lit(1.0).alias("weight"))
    a = weights.select("site_id", "src", "dst", "weight").union(own).groupBy("site_id", "src", "dst").agg(F.sum("weight").alias("a"))
    d = a.groupBy("site_id", "src").agg(F.sum("a").alias("d"))
    e = a.join(d, ["site_id", "src"]).join(d.select("site_id", F.col("src").alias("dst"), F.col("d").alias("d1")), ["site_id", "dst"])
    return e.select("site_id", "src", "dst", (F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0) + F.col("a") / F.sqrt(F.col("d") * F.col("d1"))).alias("value"))


def applied(matrix: DataFrame, signal: DataFrame) -> DataFrame:
    """(site_id, node_index, x): the matrix (site_id, src, dst, value) times the signal."""
    d = matrix.join(signal.withColumnRenamed("node_index", "dst"), ["site_id", "dst"])
    return d.groupBy("site_id", F.col("src").alias("node_index")).agg(F.sum(F.col("value") * F.col("x")).alias("x"))


def scaled_laplacian(weights: DataFrame, nodes: DataFrame, rounds: int = 20) -> DataFrame:
    """(site_id, src, dst, value) of 2 L / lambda - I, with L = I - D^-1/2 W D^-1/2 (0 for nodes without links) and lambda its largest eigenvalue.

    lambda comes by Lanczos' recurrence, whose rounds are one join and two sums each, and are written: it is exact for
    sites of at most `rounds` nodes, and close to it for others, where plain powers would take hundreds of rounds.
    """
    d = weights.groupBy("site_id", "src").agg(F.sum("weight").alias("d"))
    e = weights.where("src != dst").join(d, ["site_id", "src"]).join(d.select("site_id", F.col("src").alias("dst"), F.col("d").alias("d1")), ["site_id", "dst"])
    diagonal = nodes.select("site_id", F.col("node_index").alias("src")).join(d, ["site_id", "src"], "left").select("site_id", "src", F.col("src").alias("dst"), F.when(F.col("d") > 0, 1.0).otherwise(0.0).alias("value"))
    matrix = cut(e.where("d > 0 and d1 > 0").select("site_id", "src", "dst", (-F.col("weight") / F.sqrt(F.col("d") * F.col("d1"))).alias("value")).union(diagonal))
    start = F.pmod(F.col("node_index") * 7919 + F.col("node_index") * F.col("node_index") * 31, F.lit(101)) / 101.0 - 0.503
    x = nodes.select("site_id", "node_index", start.alias("x"))
    norm = x.groupBy("site_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    state = cut(x.join(norm, "site_id").select("site_id", "node_index", (F.col("x") / F.col("n")).alias("x"), F.lit(0.0).alias("before"), F.lit(0.0).alias("b")))
    keys, steps = ["site_id", "node_index"], []
    for k in range(rounds):
        y = applied(matrix, state.select(*keys, "x")).withColumnRenamed("x", "y").join(state, keys).withColumn("y", F.col("y") - F.col("b") * F.col("before"))
        y = cut(y)
        a = y.groupBy("site_id").agg(F.sum(F.col("x") * F.col("y")).alias("a"))
        y = y.join(a, "site_id").withColumn("y", F.col("y") - F.col("a") * F.col("x"))
        c = cut(y.groupBy("site_id", "a").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("c")))
        steps.append(c.select("site_id", F.lit(k).alias("k"), "a", "c"))
        left = F.when(F.col("c") > 1e-9, F.col("y") / F.col("c")).otherwise(0.0)
        state = cut(y.drop("b").join(c.drop("a"), "site_id").select(*keys, left.alias("x"), F.col("x").alias("before"), F.col("c").alias("b")))

    def largest(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        off = np.where(p["c"] > 1e-9, p["c"], 0.0)[:-1]
        return pd.DataFrame({"site_id": [p["site_id"].iloc[0]], "lambda": [float(np.linalg.eigvalsh(np.diag(p["a"]) + np.diag(off, 1) + np.diag(off, -1)).max())]})

    site = dict(nodes.dtypes)["site_id"]
    top = reduce(DataFrame.union, steps).groupBy("site_id").applyInPandas(largest, f"site_id {site}, lambda double")
    return matrix.join(top, "site_id").select("site_id", "src", "dst", (2 * F.col("value") / F.greatest("lambda", F.lit(1e-12)) - F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)).alias("value"))


def chebyshev(matrix: DataFrame, signal: DataFrame, order: int) -> DataFrame:
    """(site_id, node_index, k, x): the first `order` Chebyshev polynomials of the matrix, applied to the signal: k joins, not matrix products."""
    if order < 1:
        raise ValueError(f"the order must be 1 at least, not {order}")
    before, now = None, signal.select("site_id", "node_index", "x")
    out = now.withColumn("k", F.lit(0))
    for k in range(1, order):
        y = applied(matrix, now)
        if before is not None:
            y = y.withColumnRenamed("x", "y").join(before.withColumnRenamed("x", "b"), ["site_id", "node_index"]).select("site_id", "node_index", (2 * F.col("y") - F.col("b")).alias("x"))
        before, now = now, cut(y)
        out = out.union(now.withColumn("k", F.lit(k)))
    return out.select("site_id", "node_index", "k", "x")


def mdl_segmentation(d: DataFrame, by: Sequence[str], values: Sequence[str], penalty: float = 10.0, least: int = 5, rounds: int = 8) -> DataFrame:
    """(by, t): greedy splits of a many-valued series while the best split's gain exceeds max(0.5, penalty / 10) * values * ln T.

    The gain of a split is the sum over the values of the drop of n * ln(variance) / 2. A series without a worthwhile
    split stops; all series are cut at once, a round each.
    """
    found = None
    d = cut(d.select(*by, "t", *values, F.lit(0).cast("long").alias("_segment")))
    w, whole = Window.partitionBy(*by, "_segment").orderBy("t"), Window.partitionBy(*by, "_segment")
    length = Window.partitionBy(*by)
    for _ in range(rounds):
        p = d.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(whole), "_length": F.count("*").over(length)})
        total = F.lit(0.0)
        for c in values:
            s, q, ws, wq = F.sum(c).over(w), F.sum(F.col(c) ** 2).over(w), F.sum(c).over(whole), F.sum(F.col(c) ** 2).over(whole)
            code = lambda n, s, q: n / 2 * F.log(F.greatest(q / n - (s / n) ** 2, F.lit(1e-6)))
            total = total + code(F.col("n"), ws, wq) - code(F.col("i"), s, q) - code(F.col("n") - F.col("i"), ws - s, wq - q)
        p = p.withColumn("gain", F.when(F.col("n") > F.col("i"), total - max(0.5, penalty / 10) * len(values) * F.log("_length")))  # filtered after the sums, which cover whole segments
        p = p.where((F.col("i") >= least) & (F.col("n") - F.col("i") >= least) & (F.col("gain") > 1e-9))
        one = cut(p.groupBy(*by).agg(F.max_by(F.struct("_segment", (F.col("t") + 1).alias("t")), F.struct(F.round("gain", 6), "t")).alias("x")).select(*by, F.col("x._segment").alias("_cut"), F.col("x.t").alias("_at")))
        if one.isEmpty():
            break
        found = one if found is None else found.union(one)
        d = cut(d.join(one, list(by), "left").withColumn("_segment", F.when((F.col("_segment") == F.col("_cut")) & (F.col("t") >= F.col("_at")), F.col("_at")).otherwise(F.col("_segment"))).drop("_cut", "_at"))
    return (found if found is not None else one).select(*by, F.col("_at").alias("t"))
