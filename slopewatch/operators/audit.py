"""Audits of predictions over subsets that overlap: segments of samples, scopes of nodes, horizons, stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.functions.common import asof_last
from slopewatch.operators.evaluate import bootstrap_means
from slopewatch.operators.panel import NODE, stage_columns

SAMPLE = ["site_id", "start"]


def sample_context(samples: DataFrame, events: DataFrame, risk: DataFrame | None = None, coefficients: Sequence[float] = (10.0, 1.0, -5.0), lookback: int = 60, keep: Sequence[str] = ()) -> DataFrame:
    """(site_id, start, spell_days, wetness, gate, keep) of each sample by the latest event up to its origin.

    events: site_id, date, event_id, spell_days, antecedent_wetness_index; risk: site_id, start, risk, or None if samples
    have it; `keep` names their columns that stay. Samples without an event in the `lookback` days before have a spell of
    0 days and no wetness. The gate is logistic in risk and wetness.
    """
    own = [*keep] if risk is not None else [*keep, "risk"]
    d = asof_last(samples.select(*SAMPLE, "origin_date", *own), events, ["site_id"], "origin_date", "date", ["spell_days", "antecedent_wetness_index"], ["event_id"])
    ok = F.coalesce(F.datediff("origin_date", "asof_date") <= lookback, F.lit(False))
    d = d.select(*SAMPLE, *own, F.when(ok, F.col("asof_spell_days")).otherwise(0).alias("spell_days"), F.when(ok, F.col("asof_antecedent_wetness_index")).otherwise(0.0).alias("wetness"))
    a, b, c = coefficients
    linear = a * F.coalesce("risk", F.lit(0.0)) + b * F.col("wetness") + c
    d = d if risk is None else d.join(risk, SAMPLE, "left")
    return d.select(*SAMPLE, "spell_days", "wetness", (1 / (1 + F.exp(-linear))).alias("gate"), *keep)


def audit_segments(is_fallback: Column, gate: Column, spell_days: Column, wetness: Column) -> Column:
    """The names of the seven overlapping segments that a sample belongs to."""
    rules = {
        "official": ~is_fallback,
        "fallback_low_prob": is_fallback & (gate < 0.5),
        "fallback_high_prob": is_fallback & (gate >= 0.5),
        "event_active_3d": spell_days <= 3,
        "event_active_7d": (spell_days > 3) & (spell_days <= 7),
        "event_active_15d": (spell_days > 7) & (spell_days <= 15),
        "delayed_response_event": (spell_days > 0) & (wetness > 0.5),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


METRICS = ("global_mae", "rain_sensitive_mae", "h5_rain_sensitive_mae")


def sample_errors(cells: DataFrame, scopes: DataFrame, models: Sequence[str], by: Sequence[str], *more: Column) -> DataFrame:
    """(by, the metrics, more): a sample's mean absolute errors, each an array in the order of the models; `more` aggregates all its cells.

    cells: site_id, start, horizon, node_index, y_true and a column for each model. A node has its scopes in one row.
    """
    count = lambda scope: F.count(F.when(F.col("scope") == scope, 1))
    nodes = scopes.where("scope in ('all', 'rain_sensitive')").groupBy(*NODE).agg(count("all").alias("_all"), count("rain_sensitive").alias("_sensitive"))
    d = cells.join(nodes.hint("merge"), NODE, "left")

    def mean(m: str, n: Column) -> Column:
        e, n = F.abs(F.col(m) - F.col("y_true")), F.when(n > 0, n)
        return F.sum(e * n) / F.sum(F.when(e.isNotNull(), n))

    times = dict(zip(METRICS, (F.col("_all"), F.col("_sensitive"), F.when(F.col("horizon") == 5, F.col("_sensitive"))), strict=True))
    return d.groupBy(*by).agg(*[F.array(*[mean(m, n) for m in models]).alias(k) for k, n in times.items()], *more)


def segment_audit(cells: DataFrame, scopes: DataFrame, context: DataFrame, draws: int = 100) -> DataFrame:
    """segment_means() of cells with a row for each model: site_id, start, horizon, node_index, seed, model, is_fallback, y_true, y_pred."""
    s = sample_errors(cells, scopes, ["y_pred"], ["model", "seed", *SAMPLE, "is_fallback"]).join(context, SAMPLE)
    return segment_means(s, ["model", "seed"], ["y_pred"], draws).drop("value")


def segment_means(samples: DataFrame, by: Sequence[str], models: Sequence[str], draws: int = 100) -> DataFrame:
    """(by, segment, metric, value: the model, n, mean, lo, hi): means of the samples' errors in each segment, with a 90 % interval.

    samples: sample_errors() with by, is_fallback and the sample_context(). Metrics: global_mae, rain_sensitive_mae,
    h5_rain_sensitive_mae; a sample whose site has no sensitive node counts for the first only.
    """
    s = samples.withColumn("segment", F.explode(audit_segments(F.col("is_fallback"), F.col("gate"), F.col("spell_days"), F.col("wetness"))))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("e")) for n in METRICS]))
    s = s.select(*by, "segment", *SAMPLE, each.alias("x")).select(*by, "segment", "x.metric", *SAMPLE, *[F.col("x.e")[k].alias(m) for k, m in enumerate(models)])
    return bootstrap_means(s.where(F.coalesce(*models).isNotNull()), [*by, "segment", "metric"], models, SAMPLE, draws)


def event_samples(aligned: DataFrame, samples: DataFrame, flags: Sequence[str], n_his: int) -> DataFrame:
    """(site_id, start, in_event): whether any flag is set at an acquisition of the sample's history. aligned: site_id, t, the flags."""
    hot = aligned.where(F.greatest(*flags) > 0).select("site_id", "t") if len(flags) > 1 else aligned.where(F.col(flags[0]) > 0).select("site_id", "t")
    asked = samples.select(*SAMPLE, F.explode(F.sequence(F.col("start"), F.col("start") + n_his - 1)).alias("t"))
    found = asked.join(hot, ["site_id", "t"], "left_semi").select(*SAMPLE).distinct().withColumn("in_event", F.lit(True))
    return samples.select(*SAMPLE).join(found, SAMPLE, "left").fillna({"in_event": False})


def subset_metrics(w: DataFrame, by: Sequence[str], scopes: DataFrame, in_event: DataFrame, model: str, base: str, horizons: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """(by, subset, scope, horizon, n, samples, mae, rmse, base_mae, base_rmse, mae_gain, rmse_gain) against the base.

    Subsets: all samples, those in an event, and the calm ones; horizon 0 is all horizons. Gains are in percent of the
    base's error. Subsets without samples have no row.
    """
    subset = F.array_compact(F.array(F.lit("all"), F.when(F.col("in_event"), F.lit("event")).otherwise(F.lit("calm"))))
    at = F.array_compact(F.array(F.lit(0).cast("long"), F.when(F.col("horizon").isin(*horizons), F.col("horizon"))))
    d = w.join(in_event, SAMPLE).join(scopes, NODE).withColumn("subset", F.explode(subset)).withColumn("horizon", F.explode(at))
    e, b = F.col(model) - F.col("y_true"), F.col(base) - F.col("y_true")
    g = d.groupBy(*by, "subset", "scope", "horizon").agg(F.count("*").alias("n"), F.count_distinct(*SAMPLE).alias("samples"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(b)).alias("base_mae"), F.sqrt(F.avg(b * b)).alias("base_rmse"))
    gain = lambda k: 100 * (F.col(f"base_{k}") - F.col(k)) / F.greatest(f"base_{k}", F.lit(1e-6))
    return g.withColumns({"mae_gain": gain("mae"), "rmse_gain": gain("rmse")})


#: What the focus evaluation calls its pairs of subset and scope.
FOCUS = {("all", "all"): "global", ("event", "all"): "rain_event_samples", ("all", "rain_sensitive"): "rain_active_nodes", ("all", "rain_top"): "rain_top_nodes", ("event", "rain_sensitive"): "event_active_nodes", ("event", "rain_top"): "event_top_nodes"}


def focus_metrics(subsets: DataFrame) -> DataFrame:
    """The six rows of the focus evaluation among those of subset_metrics()."""
    name = F.coalesce(*[F.when((F.col("subset") == a) & (F.col("scope") == b), F.lit(n)) for (a, b), n in FOCUS.items()])
    return subsets.where("horizon = 0").withColumn("focus", name).where("focus is not null").drop("subset", "scope", "horizon")


def stage_metrics(cells: DataFrame, changes: DataFrame, n_his: int, by: Sequence[str]) -> DataFrame:
    """(by, stage_id, n, mae, rmse): errors by the number of a node's change points up to the predicted time."""
    seen = changes.groupBy(*NODE).agg(F.array_sort(F.collect_set(F.col("t").cast("long"))).alias("_c"))  # a node's change points
    t = F.col("start") + (n_his - 1) + F.col("horizon")
    stage = stage_columns(t, F.coalesce("_c", F.array().cast("array<long>")), t)["stage_id"]
    e = F.col("y_pred") - F.col("y_true")
    return cells.join(seen, NODE, "left").groupBy(*by, stage.cast("long").alias("stage_id")).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def node_map(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, site_id, node_index, n, mae, mean_error): the map of errors."""
    e = F.col("y_pred") - F.col("y_true")
    return cells.groupBy(*by, *NODE).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_error"))


def stability(gains: DataFrame, settings: Sequence[str], seed: str, gain: str, group: str | None = None) -> DataFrame:
    """(settings, seeds, mean_gain, std_gain, worst_gain, positive_seeds, stable): how a setting's gain holds over the seeds.

    stable: every seed gains. With `group`, a row for each group of settings instead: its best mean gain, the share of
    its settings that are stable, and the spread of its settings' means.
    """
    g = gains.groupBy(*settings).agg(F.count_distinct(seed).alias("seeds"), F.avg(gain).alias("mean_gain"), F.stddev_pop(gain).alias("std_gain"), F.min(gain).alias("worst_gain"), F.count(F.when(F.col(gain) > 1e-9, 1)).alias("positive_seeds"))
    g = g.withColumn("stable", F.col("positive_seeds") == F.col("seeds"))
    if group is None:
        return g
    return g.groupBy(group).agg(F.count("*").alias("settings"), F.max("mean_gain").alias("best_gain"), F.avg(F.col("stable").cast("double")).alias("stable_share"), F.stddev_pop("mean_gain").alias("spread"))
