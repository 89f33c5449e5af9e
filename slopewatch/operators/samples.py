"""Samples: folds, splits, as-of contexts of forecasts and events, priors, weights, gap filling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.common import asof_last, min_max, positive_quantile

SITE = ["site_id"]


def fixed_split(t: Column, train: int, val: int) -> Column:
    return F.when(t < train, "train").when(t < train + val, "val").otherwise("test")


def rolling_folds(samples: DataFrame, change_points: Sequence[int], n_his: int, val: int = 18, test: int = 18, gap: int = 0, least: tuple[int, int, int] = (20, 4, 4)) -> DataFrame:
    """(site_id, fold, start, part): test starts from cp - n_his on, validation before, training before that; thin folds are left out."""
    cps = F.explode(F.array(*[F.lit(c) for c in change_points]))
    d = samples.select("site_id", "start", cps.alias("cp"))
    begin = F.greatest(F.lit(0), F.col("cp") - n_his)
    v1 = F.greatest(F.lit(0), begin - gap)
    v0 = F.greatest(F.lit(0), v1 - val)
    s = F.col("start")
    part = F.when(s < v0, "train").when((s >= v0) & (s < v1), "val").when((s >= begin) & (s < begin + test), "test")
    d = d.withColumn("part", part).where("part is not null")
    count = lambda p: F.count(F.when(F.col("part") == p, 1))
    good = d.groupBy("site_id", "cp").agg(count("train").alias("a"), count("val").alias("b"), count("test").alias("c")).where((F.col("a") >= least[0]) & (F.col("b") >= least[1]) & (F.col("c") >= least[2]))
    return d.join(good.select("site_id", "cp"), ["site_id", "cp"]).select("site_id", F.concat(F.lit("cp_"), "cp").alias("fold"), "start", "part")


def stratified_split(samples: DataFrame, stage: str, seed: int = 7) -> DataFrame:
    """70/15/15 within each stage of a site, in a fixed mixed order; stages of fewer than six samples are training."""
    w = Window.partitionBy("site_id", stage)
    mix = F.pmod(F.col("start") * 7919 + seed * 104729 + F.col("start") % 11 * 613, F.lit(65521))
    d = samples.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(mix, "start")))
    train, val = F.greatest(F.lit(1), F.floor(0.7 * F.col("_n") + 0.5)), F.greatest(F.lit(1), F.floor(0.15 * F.col("_n") + 0.5))
    tight = train + val >= F.col("_n")
    train, val = F.when(tight, F.greatest(F.lit(1), F.col("_n") - 2)).otherwise(train), F.when(tight, 1).otherwise(val)
    part = F.when(F.col("_n") < 6, "train").when(F.col("_i") <= train, "train").when(F.col("_i") <= train + val, "val").otherwise("test")
    return d.withColumn("part", part).drop("_n", "_i")


def source_balanced_val(folds: DataFrame, is_fallback: str = "is_fallback") -> DataFrame:
    """Validation drawn anew from the latest of training and validation, with the test part's share of fallback samples.

    folds: site_id, fold, start, part, is_fallback. Where a source has too few samples, the latest others fill up.
    """
    by = ["site_id", "fold"]
    n = lambda c: F.count(F.when(c, 1))
    part, fb = F.col("part"), F.col(is_fallback)
    g = folds.groupBy(*by).agg(n(part == "val").alias("_v"), n((part == "test") & fb).alias("_tf"), n(part == "test").alias("_tt"))
    want = F.least(F.col("_v"), F.floor(F.col("_v") * F.col("_tf") / F.greatest("_tt", F.lit(1)) + 0.5))
    d = folds.join(g.withColumn("_wf", want), by)
    pool = d.where(part != "test").withColumn("_r", F.row_number().over(Window.partitionBy(*by, is_fallback).orderBy(F.desc("start"))))
    pool = pool.withColumn("_in", F.col("_r") <= F.when(fb, F.col("_wf")).otherwise(F.col("_v") - F.col("_wf")))
    w = Window.partitionBy(*by)
    pool = pool.withColumn("_short", F.col("_v") - F.sum(F.col("_in").cast("int")).over(w)).withColumn("_o", F.row_number().over(Window.partitionBy(*by, "_in").orderBy(F.desc("start"))))
    chosen = F.col("_in") | (F.col("_o") <= F.col("_short"))
    new = pool.select(*by, "start", is_fallback, F.when(chosen, "val").otherwise("train").alias("part"))
    return new.unionByName(folds.where(part == "test").select(*by, "start", is_fallback, "part"))


def forecast_context(samples: DataFrame, forecast: DataFrame, windows: Sequence[int] = (1, 3, 7, 15)) -> DataFrame:
    """The latest forecast issued by each sample's origin: age, source and sums over the days after it; zeros where none is
    there or it is older than the longest window. Flags use quantiles of the training samples' positive sums."""
    most = max(windows)
    f = forecast.withColumn("_fb", F.lower("source").rlike("fallback|climatology").cast("int"))
    issues = f.groupBy("site_id", "issue_date").agg(F.collect_list(F.struct("valid_date", "forecast_rain_mm")).alias("rows"), F.max("_fb").alias("fallback"))
    d = asof_last(samples, issues, SITE, "origin_date", "issue_date", ["rows", "fallback"])
    age = F.datediff("origin_date", "asof_issue_date")
    ok = F.coalesce(age <= most, F.lit(False))
    total = lambda n: F.aggregate(F.filter("asof_rows", lambda r: (r["valid_date"] > F.col("origin_date")) & (r["valid_date"] <= F.date_add("origin_date", n))), F.lit(0.0), lambda a, r: a + r["forecast_rain_mm"])
    d = d.withColumns({f"forecast_rain_{n}d": F.when(ok, total(n)).otherwise(0.0) for n in windows})
    d = d.withColumn("forecast_available", ok.cast("double")).withColumn("forecast_is_fallback", F.when(ok, F.col("asof_fallback").cast("double")).otherwise(0.0)).withColumn("forecast_issue_age_days", F.coalesce(age, F.lit(most)).cast("double"))
    fit = d.where("split = 'train'").groupBy("site_id").agg(positive_quantile("forecast_rain_15d", 0.9).alias("_p90"), positive_quantile("forecast_rain_15d", 0.95).alias("_p95"))
    d = d.join(fit, "site_id", "left")
    d = d.withColumns({f"forecast_event_p{p}_15d": F.coalesce((F.col("forecast_rain_15d") >= F.col(f"_p{p}")).cast("double"), F.lit(0.0)) for p in (90, 95)})
    return d.drop("asof_rows", "asof_fallback", "asof_issue_date", "_p90", "_p95")


def event_priors(events: DataFrame) -> DataFrame:
    """Share of earlier events of the same wetness and rain level with a response, smoothed (s + 1) / (n + 2); of all earlier
    ones where the class is new; 0.5 for the first event. Only earlier rows by (date, event_id) count."""
    order = ["date", "event_id"]
    before = lambda *by: Window.partitionBy("site_id", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.col("is_response_event").cast("int")
    same, whole = before("wetness_level", "rain_level"), before()
    n, a = F.count("*").over(same), F.count("*").over(whole)
    s, b = F.coalesce(F.sum(hit).over(same), F.lit(0)), F.coalesce(F.sum(hit).over(whole), F.lit(0))
    d = events.withColumns({"_n": n, "_a": a, "_s": s, "_b": b})
    used, got = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_a")), F.when(F.col("_n") > 0, F.col("_s")).otherwise(F.col("_b"))
    return d.withColumn("historical_trigger_probability", F.when(used > 0, (got + 1.0) / (used + 2.0)).otherwise(0.5)).withColumn("historical_trigger_count", used).drop("_n", "_a", "_s", "_b")


def level_code(level: Column) -> Column:
    return F.when(level.startswith("W3") | level.startswith("P95"), 3).when(level.startswith("W2") | level.startswith("P90"), 2).when(level.startswith("W1") | level.startswith("P75"), 1).otherwise(0)


def event_context(samples: DataFrame, events: DataFrame, lookback: int = 60) -> DataFrame:
    """One row for each sample: the latest event by its origin, if not older than `lookback` days; else zeros."""
    payload = ["rain_mm", "spell_rain_sum", "antecedent_wetness_index", "wetness_level", "rain_level", "historical_trigger_probability", "historical_trigger_count"]
    d = asof_last(samples, events, SITE, "origin_date", "date", payload, ["event_id"])
    age = F.datediff("origin_date", "asof_date")
    ok = F.coalesce(age <= lookback, F.lit(False))
    d = d.withColumn("event_available", ok.cast("double")).withColumn("event_age_days", F.when(ok, age).otherwise(lookback).cast("double"))
    d = d.withColumns({f"event_{n}_{k}d": (ok & (age <= k)).cast("double") for n, k in (("active", 3), ("active", 7), ("active", 15), ("recent", 30))})
    values = {f"event_{c}": F.when(ok, F.col(f"asof_{c}")).otherwise(0.0) for c in payload if not c.endswith("level")}
    codes = {f"event_{c}_code": F.when(ok, level_code(F.col(f"asof_{c}"))).otherwise(0) for c in ("wetness_level", "rain_level")}
    return d.withColumns(values | codes).drop("asof_date", *[f"asof_{c}" for c in payload])


def event_weights(context: DataFrame, strength: float = 1.0) -> DataFrame:
    """1 + strength * the largest of the active flags (scaled 1, 0.75, 0.5) and a quarter of the scaled wetness."""
    d = min_max(context, SITE, "event_antecedent_wetness_index", "_w")
    flags = [F.col("event_active_3d"), 0.75 * F.col("event_active_7d"), 0.5 * F.col("event_active_15d"), 0.25 * F.col("_w")]
    return d.withColumn("weight", 1 + strength * F.greatest(*flags)).drop("_w")


def normalised_context(d: DataFrame, flags: Sequence[str], ages: dict[str, float], others: Sequence[str]) -> DataFrame:
    """Flags clipped to [0, 1], ages over their caps, everything else log1p, z-scored by training samples, clipped to 5."""
    d = d.withColumns({c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) for c in flags} | {c: F.least(F.col(c), F.lit(m)) / m for c, m in ages.items()} | {c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in others})
    stats = d.where("split = 'train'").groupBy("site_id").agg(*[F.avg(c).alias(f"_m{c}") for c in others], *[F.stddev_pop(c).alias(f"_s{c}") for c in others])
    d = d.join(stats, "site_id")
    z = lambda c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") >= 1e-6, F.col(f"_s{c}")).otherwise(1.0)
    return d.withColumns({c: F.least(F.greatest(z(c), F.lit(-5.0)), F.lit(5.0)) for c in others}).drop(*[f"_{k}{c}" for c in others for k in "ms"])


def seasonal_sums(rain: DataFrame, origins: DataFrame) -> DataFrame:
    """(site_id, year, doy, own_s, own_n, prev_s, prev_n): running sums and counts of rain over the days of a year up to
    doy (0 to 366), and the same summed up over all earlier years. Years reach from a site's first rain to its last origin."""
    days = rain.groupBy("site_id", F.year("date").alias("year"), F.dayofyear("date").alias("doy")).agg(F.coalesce(F.sum("rain_mm"), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    years = days.select("site_id", "year").union(origins.select("site_id", F.year("origin_date").alias("year"))).groupBy("site_id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    grid = years.select("site_id", F.explode(F.sequence("a", "b")).alias("year")).withColumn("doy", F.explode(F.sequence(F.lit(0), F.lit(366))))
    d = grid.join(days, ["site_id", "year", "doy"], "left").fillna(0, ["s", "n"])
    within = Window.partitionBy("site_id", "year").orderBy("doy").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("site_id", "year", "doy", *[F.sum(c).over(within).alias(f"own_{c}") for c in "sn"])
    earlier = Window.partitionBy("site_id", "doy").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    return d.select("*", *[F.coalesce(F.sum(f"own_{c}").over(earlier), F.lit(0)).alias(f"prev_{c}") for c in "sn"])


def last_days(rain: DataFrame, days: int) -> DataFrame:
    """(site_id, date, m<days>): mean rain of the `days` days before each day, put together from sums of 15; `days` is a multiple of that."""
    w = Window.partitionBy("site_id").orderBy("date")
    back = lambda c, ns: [F.coalesce(F.lag(c, n).over(w), F.lit(0.0)) for n in ns]
    total = lambda xs: sum(xs[1:], xs[0])
    d = rain.select("site_id", "date", "rain_mm", F.count("rain_mm").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_n"))
    d = d.withColumn("_s15", total(back("rain_mm", range(1, 16))))
    n = F.col("_n") - F.coalesce(F.lag("_n", days).over(w), F.lit(0))
    s = total([F.col("_s15"), *back("_s15", range(15, days, 15))])
    return d.select("site_id", "date", F.when(n > 0, s / n).alias(f"m{days}"))


def climatology_fill(origins: DataFrame, rain: DataFrame, leads: int = 15, half: int = 30, least: int = 5) -> DataFrame:
    """(site_id, origin_date, lead, valid_date, forecast_rain_mm): mean of earlier rain within `half` days of the year of
    each lead day; where fewer than `least` days are known, the mean of the last 90 days, else of all earlier days.

    Sums and counts come from running sums over (day of the year, year): the days near a lead day are one stretch of
    the year, or two around its end, and each end of a stretch is two places of an origin's arrays, one for all earlier
    years and one for the origin's own year, which ends before the origin. Leads become rows only when they are known.
    """
    sums = seasonal_sums(rain, origins)
    names = [f"{of}_{c}" for of in ("own", "prev") for c in "sn"]
    # a year's running sums are arrays by the day of the year, so an origin meets one row and its leads are read off it
    years = sums.groupBy("site_id", "year").agg(F.array_sort(F.collect_list(F.struct("doy", *names))).alias("_d"))
    years = years.select("site_id", "year", *[F.col(f"_d.{n}").alias(n) for n in names])
    # origins and years look small to the planner, which would broadcast them
    d = origins.hint("merge").withColumn("year", F.year("origin_date")).join(years.hint("merge"), ["site_id", "year"], "left")
    d = d.join(last_days(rain, 90).select("site_id", F.col("date").alias("origin_date"), "m90"), ["site_id", "origin_date"], "left")
    until = lambda c, at: F.get(f"prev_{c}", at) + F.get(f"own_{c}", F.least(at, F.dayofyear("origin_date") - 1))

    def near(c: str, v: Column) -> Column:
        inside = until(c, F.least(v + half, F.lit(366))) - until(c, F.greatest(v - half, F.lit(1)) - 1)
        before = F.when(v - half < 1, until(c, F.lit(366)) - until(c, v - half + 365)).otherwise(0)
        after = F.when(v + half > 366, until(c, v + half - 366) - until(c, F.lit(0))).otherwise(0)
        return inside + before + after

    def at(lead: Column) -> Column:
        v = F.dayofyear(F.date_add("origin_date", lead))
        return F.struct(lead.alias("lead"), F.date_add("origin_date", lead).alias("valid_date"), near("s", v).alias("s"), near("n", v).alias("n"))

    each = F.explode(F.transform(F.sequence(F.lit(1), F.lit(leads)), at)).alias("x")
    d = d.select("site_id", "origin_date", "m90", each).select("site_id", "origin_date", "x.*", "m90")
    value = F.when(F.col("n") >= least, F.col("s") / F.col("n")).otherwise(F.coalesce("m90", F.lit(0.0)))
    return d.select("site_id", "origin_date", "lead", "valid_date", F.greatest(value, F.lit(0.0)).alias("forecast_rain_mm"))


def analog_fill(origins: DataFrame, rain: DataFrame, k: int = 5, leads: int = 15, sums: Sequence[int] = (3, 7, 15, 30), least: int = 20) -> DataFrame:
    """(site_id, origin_date, lead, forecast_rain_mm): mean of the rain that followed the k earlier days most like the origin.

    Likeness: distance of the sums over the days before, each over its spread, and half the seasonal distance.
    Candidates are all days of the same site that have the longest sum's days before them and whose leads end before
    the origin. Origins with fewer than `least` candidates get no rows. A site's days meet its origins in one group, where the
    following rain is at hand too; pairs are never rows, and nothing is shuffled after it.
    """
    w = lambda n: Window.partitionBy("site_id").orderBy("date").rowsBetween(-n, -1)
    names = [f"s{n}" for n in sums]
    f = rain.select("site_id", F.unix_date("date").alias("day"), F.dayofyear("date").alias("doy"), "rain_mm", *[F.coalesce(F.sum("rain_mm").over(w(n)), F.lit(0.0)).alias(f"s{n}") for n in sums])
    o = origins.select(F.col("site_id").alias("_site"), F.unix_date("origin_date").alias("origin")).distinct()
    ahead = np.arange(1, leads + 1)

    def task(key, f, o):
        f = f.sort_values("day")
        day, doy, rain_mm = f["day"].to_numpy(), f["doy"].to_numpy(), f["rain_mm"].to_numpy(float)
        s = [f[n].to_numpy() / max(f[n].to_numpy().std(), 1e-6) if len(f) else f[n].to_numpy() for n in names]
        first = int(np.searchsorted(day, day[0] + max(sums))) if len(day) else 0
        found = []
        for origin in o["origin"].to_numpy():
            at, last = int(np.searchsorted(day, origin)), int(np.searchsorted(day, origin - leads))
            if at == len(day) or day[at] != origin or last - first < least:
                continue
            c = slice(first, last)
            apart = np.abs(doy[at] - doy[c])
            d = 0.5 * np.minimum(apart, 366 - apart) / 183.0
            for x in s:
                d = d + np.abs(x[at] - x[c])
            d = np.round(d, 9)
            # the k least, ties to the earlier day: only days up to the k-th distance are sorted
            close = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            close = close[np.argsort(d[close], kind="stable")[:k]]
            then = day[c][close][:, None] + ahead
            to = np.minimum(np.searchsorted(day, then), len(day) - 1)
            there = day[to] == then
            known = there & ~np.isnan(rain_mm[to])
            n = known.sum(0)
            mean = np.where(n > 0, np.where(known, rain_mm[to], 0.0).sum(0) / np.maximum(n, 1), np.nan)
            any_ = there.any(0)
            found.append((np.full(any_.sum(), origin), ahead[any_], mean[any_]))
        if not found:
            return pd.DataFrame(columns=["site_id", "origin", "lead", "forecast_rain_mm"])
        origin, lead, mean = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"site_id": key[0], "origin": origin, "lead": lead, "forecast_rain_mm": pd.Series(mean).astype(object).where(~np.isnan(mean), None)})

    filled = f.groupBy("site_id").cogroup(o.groupBy("_site")).applyInPandas(task, f"site_id {dict(origins.dtypes)['site_id']}, origin int, lead int, forecast_rain_mm double")
    return filled.select("site_id", F.date_from_unix_date("origin").alias("origin_date"), "lead", "forecast_rain_mm")
