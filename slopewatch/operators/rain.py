"""Daily rain: dense calendars, antecedent sums, aligned features, the catalog of rain events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.common import beside, interpolated, positive_quantile, quantile, range_by_day, robust_scales, with_stats

SITE = ["site_id"]


def _rows(n_before: int, n_after: int) -> Window:
    return Window.partitionBy("site_id").orderBy("date").rowsBetween(n_before, n_after)


def dense_days(rain: DataFrame, start, end, fill: float = 0.0, interpolate: Sequence[str] = ()) -> DataFrame:
    """Every day from start to end for each site; missing rain is `fill`, other columns are interpolated."""
    days = rain.select("site_id").distinct().withColumn("date", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    out = days.join(rain, ["site_id", "date"], "left").fillna({"rain_mm": fill})
    for c in interpolate:
        out = interpolated(out.withColumn("_n", F.unix_date("date")), SITE, "_n", c).drop("_n")
    return out


def merged_climate(rain: DataFrame, climate: DataFrame) -> DataFrame:
    """rain with the climate's columns by site and date; where both have a column the climate's wins."""
    keys = ["site_id", "date"]
    return rain.drop(*[c for c in climate.columns if c in rain.columns and c not in keys]).join(climate, keys, "left")


def thresholds(rain: DataFrame) -> DataFrame:
    """(site_id, P50, P75, P90, P95) of the days with rain."""
    return rain.groupBy("site_id").agg(*[positive_quantile("rain_mm", q / 100).alias(f"P{q}") for q in (50, 75, 90, 95)])


def with_thresholds(rain: DataFrame) -> DataFrame:
    """rain with the thresholds() of its site."""
    d = beside(rain, SITE, _p=F.percentile(F.when(F.col("rain_mm") > 0, F.col("rain_mm")), F.array(*[F.lit(q / 100) for q in (50, 75, 90, 95)])))
    return d.withColumns({f"P{q}": F.col("_p")[i] for i, q in enumerate((50, 75, 90, 95))}).drop("_p")


def rain_background(rain: DataFrame) -> DataFrame:
    """Sums and day counts of the days before each day, and sums of those after it (for diagnosis only).

    rain: a dense calendar (site_id, date, rain_mm). Windows are short at a site's start; forward sums are 0 where
    fewer than d - 1 days follow. Sums and maxima of long windows are put together from those of shorter ones, and day
    counts are differences of running ones, so that a day costs some sixty lookups instead of a pass over each window.
    """
    w = Window.partitionBy("site_id").orderBy("date")
    back = lambda c, *ns: [F.coalesce(F.lag(c, n).over(w), F.lit(0)) for n in ns]
    ahead = lambda c, *ns: [F.coalesce(F.lead(c, n).over(w), F.lit(0)) for n in ns]
    total = lambda first, *more: sum(more, first)
    d = with_thresholds(rain)
    flags = {"rainy": F.col("rain_mm") >= 1.0, "p75": F.col("rain_mm") >= F.col("P75"), "p90": F.col("rain_mm") >= F.col("P90"), "p95": F.col("rain_mm") >= F.col("P95")}
    d = d.withColumns({f"{n}_day": F.coalesce(c, F.lit(False)).cast("int") for n, c in flags.items()})
    running = {f"_{n}": F.sum(f"{n}_day").over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in flags}
    d = d.withColumns(running | {"pre3_rain_sum": total(*back("rain_mm", 1, 2, 3)), "_post3": total(*ahead("rain_mm", 1, 2, 3))})
    between = lambda n, days: back(f"_{n}", 1)[0] - back(f"_{n}", days + 1)[0]
    out = {f"pre{n}_rainy_days": between("rainy", n) for n in (3, 7, 15, 30, 45, 60)}
    out |= {f"pre{n}_p{p}_days": between(f"p{p}", n) for n in (30, 60) for p in (75, 90, 95)}
    out |= {"pre7_rain_sum": total(F.col("pre3_rain_sum"), *back("pre3_rain_sum", 3), *back("rain_mm", 7)), "_post7": total(F.col("_post3"), *ahead("_post3", 3), *ahead("rain_mm", 7))}
    out |= {"pre15_rain_sum": total(F.col("pre3_rain_sum"), *back("pre3_rain_sum", 3, 6, 9, 12)), "_post15": total(F.col("_post3"), *ahead("_post3", 3, 6, 9, 12))}
    d = d.withColumns(out)
    longer = {f"pre{n}_rain_sum": total(F.col("pre15_rain_sum"), *back("pre15_rain_sum", *range(15, n, 15))) for n in (30, 45, 60)}
    d = d.withColumns(longer | {"_post30": total(F.col("_post15"), *ahead("_post15", 15))})
    d = d.withColumns({f"post{n}_rain_sum": F.when(F.lead(F.lit(1), n - 1).over(w).isNotNull(), F.col(f"_post{n}")).otherwise(0.0) for n in (3, 7, 15, 30)})
    most = lambda c, *ns: F.greatest(c, *[F.lag(c, n).over(w) for n in ns])
    d = d.withColumns({f"_most{n}": most(f"pre{n}_rain_sum", 1, 2, 3, 4, 5) for n in (7, 15, 30)})
    d = d.withColumns({f"max_roll{n}_before": most(f"_most{n}", 6, 12, 18, 24) for n in (7, 15, 30)})
    return d.drop(*[f"_{n}" for n in flags], *[f"_post{n}" for n in (3, 7, 15, 30)], *[f"_most{n}" for n in (7, 15, 30)])


def event_candidates(background: DataFrame) -> DataFrame:
    """Days of much rain, or of some rain on wet ground, with their event_selection_score."""
    d = beside(background, SITE, wet60_q80=quantile("pre60_rain_sum", 0.8), wet30_q80=quantile("pre30_rain_sum", 0.8))
    wet = (F.col("pre60_rain_sum") >= F.col("wet60_q80")) | (F.col("pre30_rain_sum") >= F.col("wet30_q80"))
    d = d.where((F.col("rain_mm") >= F.col("P75")) | (F.col("rain_mm") >= F.col("P50")) & wet).drop("wet60_q80", "wet30_q80")
    d = robust_scales(d, SITE, ["pre30_rain_sum", "pre60_rain_sum"])
    score = F.col("rain_mm") / F.greatest("P95", F.lit(1e-6)) + 0.5 * F.col("scaled_pre30_rain_sum") + 0.5 * F.col("scaled_pre60_rain_sum")
    return d.withColumn("event_selection_score", score).drop("scaled_pre30_rain_sum", "scaled_pre60_rain_sum")


def select_events(candidates: DataFrame, rain: DataFrame, gap: int = 7) -> DataFrame:
    """Candidates by score, each unless one within `gap` days is already kept; with the extents of their wet spells and ids.

    The order is total: score, rain, then earlier date. A site's candidates, with all their columns, are folded in one array
    expression, and each event meets the days around it once: candidates are neither kept nor read again.
    """
    columns = [c for c in candidates.columns if c != "site_id"]
    candidate = F.struct((-F.round("event_selection_score", 9)).alias("a"), (-F.col("rain_mm")).alias("b"), F.unix_date("date").alias("n"), F.struct(*columns).alias("row"))
    ranked = candidates.groupBy("site_id").agg(F.array_sort(F.collect_list(candidate)).alias("r"))
    kept = F.aggregate("r", F.slice("r", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: F.abs(k["n"] - x["n"]) <= gap), acc).otherwise(F.concat(acc, F.array(x))))
    events = ranked.select("site_id", F.explode(kept).alias("e")).select("site_id", "e.row.*").select(*candidates.columns)
    spans = events.withColumns({"_lo": F.date_sub("date", gap), "_hi": F.date_add("date", gap)})
    near = range_by_day(spans, rain.select("site_id", F.col("date").alias("day"), F.col("rain_mm").alias("r")), SITE, "_lo", "_hi", "day")
    wet = F.col("r") > 0
    pick = lambda agg: lambda c: F.coalesce(agg(F.when(wet, c)), agg(c))
    first, last, most, total = pick(F.min)(F.col("day")), pick(F.max)(F.col("day")), pick(F.max)(F.col("r")), F.sum("r")
    spells = near.groupBy(*candidates.columns).agg(first.alias("spell_start"), last.alias("spell_end"), total.alias("spell_rain_sum"), most.alias("spell_peak_rain"))
    spells = spells.withColumn("spell_days", F.datediff("spell_end", "spell_start") + 1)
    number = F.row_number().over(Window.partitionBy("site_id").orderBy("date"))
    return spells.withColumn("event_id", F.concat(F.lit("E"), F.lpad(number.cast("string"), 3, "0")))


def active_nodes(susceptibility: DataFrame, q: float = 0.75) -> DataFrame:
    """(site_id, node_index) with a positive susceptibility; for sites without one, from the q-quantile of the dense score on."""
    d = with_stats(susceptibility, SITE, _any=F.max((F.col("rain_susceptibility") > 0).cast("int")), _q=quantile("rain_susceptibility_dense", q))
    keep = F.when(F.col("_any") == 1, F.col("rain_susceptibility") > 0).otherwise(F.col("rain_susceptibility_dense") >= F.col("_q"))
    return d.where(keep).select("site_id", "node_index")


def label_response(events: DataFrame, change_points: DataFrame, active: DataFrame, lags: Sequence[int] = (3, 7, 15), profiles: Sequence[str] = ("strict", "medium"), least: int = 3) -> DataFrame:
    """Events with the nodes that changed within each lag after them, their share of the active nodes, and labels."""
    cps = change_points.where(F.col("profile").isin(*profiles)).join(active, ["site_id", "node_index"], "left_semi").select("site_id", "node_index", F.col("date").alias("day"))
    share = active.groupBy("site_id").agg(F.count("*").alias("_active"))
    spans = events.select("site_id", "date", F.date_add("date", max(lags)).alias("_end"))
    hits = range_by_day(spans.withColumn("_from", F.col("date")), cps, SITE, "_from", "_end", "day")
    within = lambda lag: F.datediff("day", "date") <= lag
    counts = hits.groupBy("site_id", "date").agg(
        *[F.count_distinct(F.when(within(lag), F.col("node_index"))).alias(f"response_nodes_{lag}d") for lag in lags],
        *[F.count(F.when(within(lag), 1)).alias(f"cp_records_{lag}d") for lag in lags],
    )
    d = events.join(counts, ["site_id", "date"], "left").join(share, "site_id", "left")
    zero = {f"{n}_{lag}d": 0 for n in ("response_nodes", "cp_records") for lag in lags}
    d = d.fillna(zero)
    d = d.withColumns({f"trigger_probability_{lag}d": F.col(f"response_nodes_{lag}d") / F.greatest(F.coalesce("_active", F.lit(0)), F.lit(1)) for lag in lags})
    d = d.withColumns({f"is_response_event_{lag}d": F.col(f"response_nodes_{lag}d") >= least for lag in lags})
    most, p = F.greatest(*[f"response_nodes_{lag}d" for lag in lags]), F.greatest(*[f"trigger_probability_{lag}d" for lag in lags])
    window, first = F.lit(None), F.lit(0)
    for lag in reversed(lags):
        window = F.when(F.col(f"trigger_probability_{lag}d") == p, lag).otherwise(window)
        first = F.when(F.col(f"is_response_event_{lag}d"), lag).otherwise(first)
    *early, late = lags
    any_early = F.lit(False)
    for lag in early:
        any_early = any_early | F.col(f"is_response_event_{lag}d")
    return d.drop("_active").withColumns(
        {"trigger_probability": p, "response_nodes_max": most, "dominant_response_window": window, "is_response_event": any_early | F.col(f"is_response_event_{late}d"), "first_response_lag_days": first, "delayed_response_event": F.col(f"is_response_event_{late}d") & ~any_early}
    )


#: What the wetness index is the mean of.
WETNESS = ("pre15_rain_sum", "pre30_rain_sum", "pre60_rain_sum", "pre60_p90_days", "max_roll30_before")


def wetness_index(events: DataFrame) -> DataFrame:
    parts = list(WETNESS)
    d = robust_scales(events, SITE, parts)
    return d.withColumn("antecedent_wetness_index", sum((F.col(f"scaled_{c}") for c in parts[1:]), F.col(f"scaled_{parts[0]}")) / 5.0).drop(*[f"scaled_{c}" for c in parts])


def rain_level(rain: Column) -> Column:
    return F.when(rain >= F.col("P95"), "P95_extreme").when(rain >= F.col("P90"), "P90_heavy").when(rain >= F.col("P75"), "P75_moderate").otherwise("below_P75_wet_background")


def assign_levels(events: DataFrame, least: int = 3, active_count: int = 1) -> DataFrame:
    """Wetness, response and rain levels, and the class of each event. Events without a response of enough nodes are R0."""
    w = F.col("antecedent_wetness_index")
    d = beside(wetness_index(events), SITE, _q33=quantile(w, 0.33), _q66=quantile(w, 0.66), _q85=quantile(w, 0.85))
    wet = F.when(w >= F.col("_q85"), "W3_very_wet").when(w >= F.col("_q66"), "W2_wet").when(w >= F.col("_q33"), "W1_moderate").otherwise("W0_dry")
    p, none = F.col("trigger_probability"), "R0_below_event_threshold"
    response = F.when(F.col("response_nodes_max") < least, none).when(p >= 0.3, "R3_strong").when(p >= 0.1, "R2_moderate").when(p >= least / max(active_count, 1), "R1_weak").otherwise(none)
    d = d.withColumns({"wetness_level": wet, "response_level": response, "rain_level": rain_level(F.col("rain_mm"))}).drop("_q33", "_q66", "_q85")
    level = F.col("response_level")
    high_wet, dry = F.col("wetness_level").isin("W2_wet", "W3_very_wet"), F.col("wetness_level") == "W0_dry"
    strong, moderate = level == "R3_strong", level == "R2_moderate"
    heavy, extreme = F.col("rain_mm") >= F.col("P90"), F.col("rain_mm") >= F.col("P95")
    kind = (
        F.when(F.col("delayed_response_event") & level.isin("R1_weak", "R2_moderate", "R3_strong"), "delayed_trigger")
        .when(high_wet & strong & ~heavy, "wet_background_trigger")
        .when(high_wet & strong, "saturated_high_trigger")
        .when(extreme & dry & (F.col("dominant_response_window") >= 15), "dry_extreme_delayed")
        .when(heavy & level.isin(none, "R1_weak"), "strong_rain_weak_response")
        .when(moderate | strong, "moderate_trigger")
        .otherwise("weak_or_no_response")
    )
    return d.withColumn("event_class", kind)


def threshold_events(rain: DataFrame, lags: Sequence[int] = (3, 7, 15, 30)) -> DataFrame:
    """(site_id, threshold_level, date, lag_days, window_end): each day at each level that it passes, with each lag window."""
    d = with_thresholds(rain).where("rain_mm > 0")
    levels = F.array(*[F.when(F.col("rain_mm") >= F.col(p), F.lit(p)) for p in ("P50", "P75", "P90", "P95")])
    d = d.select("site_id", "date", F.explode(F.array_compact(levels)).alias("threshold_level")).withColumn("lag_days", F.explode(F.array(*map(F.lit, lags))))
    return d.withColumn("window_end", F.date_add("date", F.col("lag_days")))


def align_rain(rain: DataFrame, acquisitions: DataFrame, has: Sequence[str] = ()) -> DataFrame:
    """Features of each acquisition date from the dense daily rain up to it.

    rain: site_id, date, rain_mm and, if named in `has`, hydrological columns. acquisitions: site_id, date.
    """
    # sums and maxima of long windows are put together from those of shorter ones, as in rain_background()
    w = Window.partitionBy("site_id").orderBy("date")
    plus = lambda c, *ns: sum((F.coalesce(F.lag(c, n).over(w), F.lit(0.0)) for n in ns), F.coalesce(F.col(c), F.lit(0.0)))
    most = lambda c, *ns: F.greatest(c, *[F.lag(c, n).over(w) for n in ns])
    d = rain.withColumns({"rain_0d": F.col("rain_mm"), "_sum3": plus("rain_mm", 1, 2), "_max3": most("rain_mm", 1, 2), "_cum": F.sum("rain_mm").over(_rows(Window.unboundedPreceding, 0))})
    d = d.withColumns({"_sum7": plus("_sum3", 3) + F.coalesce(F.lag("rain_mm", 6).over(w), F.lit(0.0)), "_max7": most("_max3", 3, 4), "_sum15": plus("_sum3", 3, 6, 9, 12)})
    d = d.withColumns({"_max15": most("_max7", 7, 8), "_sum30": plus("_sum15", 15)}).withColumn("_max30", most("_max15", 15))
    d = d.withColumns({f"rain_{n}d": F.when(F.col(f"_max{n}").isNotNull(), F.col(f"_sum{n}")) for n in (3, 7, 15, 30)})  # null where no day is known
    d = d.drop("_max30", *[f"_sum{n}" for n in (3, 7, 15, 30)])
    back = _rows(-44, 0)
    ages = F.collect_list("rain_mm").over(back)
    indexed = lambda f: F.aggregate(F.transform(F.reverse("_window"), f), F.lit(0.0), lambda a, x: a + x)
    d = beside(d, SITE, _p90=positive_quantile("rain_mm", 0.9), _p95=positive_quantile("rain_mm", 0.95), _q95=quantile("rain_mm", 0.95), _med=quantile("rain_30d", 0.5))
    d = d.withColumn("_window", ages)
    if "soil_moisture" in has:
        d = d.withColumn("_soil", F.avg("soil_moisture").over(_rows(-29, 0)))
        d = with_stats(d, SITE, _sm=F.avg("soil_moisture"), _ss=F.stddev_pop("soil_moisture"))
    for c in {"runoff", "surface_runoff", "subsurface_runoff", "evapotranspiration"} & set(has):
        d = d.withColumn(f"_{c}", F.sum(c).over(_rows(-14 if c == "evapotranspiration" else -6, 0)))
    a = acquisitions.select("site_id", "date").distinct().join(d, ["site_id", "date"])
    previous = F.lag("_cum").over(Window.partitionBy("site_id").orderBy("date"))
    a = a.withColumn("rain_since_last", F.coalesce(F.col("_cum") - previous, F.col("rain_0d")))
    a = a.withColumns({f"rain_event_p{p}_{n}d": F.coalesce((F.col(f"_max{n}") >= F.col(f"_p{p}")).cast("double"), F.lit(0.0)) for p in (90, 95) for n in (3, 7, 15)})
    a = a.withColumn("effective_exp45", indexed(lambda x, i: x * F.pow(F.lit(0.9), i))).withColumn("effective_power45", indexed(lambda x, i: x / F.pow(i + 1.0, F.lit(1.25))))
    a = a.withColumn("short_long_ratio", F.col("rain_7d") / F.greatest("rain_30d", F.lit(1e-6)))
    a = a.withColumn("dry_to_wet", ((F.col("rain_7d") > 0) & (F.col("rain_30d") <= F.col("_med"))).cast("double"))
    flows = [c for c in ("runoff", "surface_runoff", "subsurface_runoff") if c in has]
    a = a.withColumn("runoff_proxy", sum((F.col(f"_{c}") for c in flows[1:]), F.col(f"_{flows[0]}")) if flows else F.col("rain_3d") * F.col("short_long_ratio"))
    soil = (F.col("_soil") - F.col("_sm")) / F.when(F.col("_ss") >= 1e-6, F.col("_ss")).otherwise(1.0) if "soil_moisture" in has else F.col("effective_exp45") / F.greatest("_q95", F.lit(1e-6))
    a = a.withColumn("soil_anomaly", soil)
    a = a.withColumn("water_balance_15d", F.col("rain_15d") - F.col("_evapotranspiration") if "evapotranspiration" in has else F.col("rain_15d"))
    a = a.withColumn("memory_index", 0.40 * F.col("effective_exp45") + 0.25 * F.col("soil_anomaly") + 0.20 * F.col("runoff_proxy") + 0.15 * F.col("rain_since_last"))
    return a.drop(*[c for c in a.columns if c.startswith("_")], "rain_mm", *has)


def standardised(features: DataFrame, names: Sequence[str], fit: Column | None = None) -> DataFrame:
    """Z-scores over each site, of rows where `fit` holds (all by default); constant features have a deviation of 1."""
    use = F.lit(True) if fit is None else fit
    stats = features.where(use).groupBy("site_id").agg(*[F.avg(c).alias(f"_m_{c}") for c in names], *[F.stddev_pop(c).alias(f"_s_{c}") for c in names])
    d = features.join(stats, "site_id")
    return d.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") >= 1e-6, F.col(f"_s_{c}")).otherwise(1.0) for c in names}).drop(*[f"_{k}_{c}" for c in names for k in "ms"])


def class_summary(events: DataFrame) -> DataFrame:
    """Count, mean rain, wetness and response of each event class."""
    return events.groupBy("event_class").agg(F.count("*").alias("n"), F.avg("rain_mm").alias("mean_rain"), F.avg("antecedent_wetness_index").alias("mean_wetness"), F.avg("trigger_probability").alias("mean_probability"), F.max("response_nodes_max").alias("most_nodes"))


