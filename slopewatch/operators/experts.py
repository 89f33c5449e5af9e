"""Experts on the long prediction table: baselines, calibration, blending and routing. Fitted on validation rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.common import clip

CELL = ["site_id", "start", "horizon", "node_index"]


SIMPLE = ("persistence", "damped", "trend")


def expert_cells(panel: DataFrame, n_his: int, n_pred: int, keep: Sequence[str] = ()) -> DataFrame:
    """(site_id, start, horizon, node_index, y_true, persistence, damped, trend, keep) of every window: the last observation repeated,
    a damped velocity of the last five observations, and a trend of the last three. One pass of windows over the panel, no join;
    `keep` names columns of the panel that a cell takes from its origin, the last observation."""
    w = Window.partitionBy("site_id", "node_index").orderBy("t")
    ahead = [F.lead("disp", h).over(w) for h in range(1, n_pred + 1)]
    d = panel.select("site_id", "node_index", "t", "disp", *keep, F.lag("disp", 4).over(w).alias("d4"), F.lag("disp", 2).over(w).alias("d2"), F.array(*ahead).alias("ahead"), F.row_number().over(w).alias("seen"))
    d = d.where(~F.exists("ahead", F.isnull) & (F.col("seen") >= n_his)).withColumn("start", F.col("t") - n_his + 1)
    d = d.select("site_id", "start", "node_index", "disp", "d4", "d2", *keep, F.posexplode("ahead").alias("h", "y_true")).withColumn("horizon", (F.col("h") + 1).cast("long"))
    models = [("persistence", F.col("disp")), ("damped", F.col("disp") + 0.5 * F.col("horizon") * (F.col("disp") - F.col("d4")) / 4.0), ("trend", F.col("disp") + 0.25 * F.col("horizon") * (F.col("disp") - F.col("d2")))]
    return d.select(*CELL, "y_true", *[c.alias(n) for n, c in models], *keep)


def simple_experts(panel: DataFrame, n_his: int, n_pred: int) -> DataFrame:
    """(site_id, start, horizon, node_index, y_true, model, y_pred): a row for each expert of expert_cells()."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("y_pred")) for n in SIMPLE]))
    return expert_cells(panel, n_his, n_pred).select(*CELL, "y_true", each.alias("m")).select(*CELL, "y_true", "m.model", "m.y_pred")


def wide(predictions: DataFrame, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell with a column for each model: aggregated, so a cell's models meet without a join."""
    pick = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models]
    return predictions.where(F.col("model").isin(*models)).groupBy(*CELL, "y_true", *keep).agg(*pick)


def persistence(panel: DataFrame, n_his: int, n_pred: int) -> DataFrame:
    return simple_experts(panel, n_his, n_pred).where("model = 'persistence'")


def node_gain(d: DataFrame, by: Sequence[str], predicted: str, target: str, shrink: float = 1.0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Closed-form gain of each node: the clipped least-squares factor from predicted to target changes."""
    g = d.groupBy(*by).agg(F.sum(F.col(predicted) * F.col(target)).alias("_pt"), F.sum(F.col(predicted) ** 2).alias("_pp"))
    return g.select(*by, (clip(F.col("_pt") / (F.col("_pp") + 1e-6), low, high) * shrink).alias("gain"))


def errors(true: Column, predicted: Column) -> dict[str, Column]:
    e = predicted - true
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "n": F.count("*")}


def best_blend(w: DataFrame, a: str, b: str, by: Sequence[str], steps: int = 40) -> DataFrame:
    """The blend factor alpha of a * alpha + b * (1 - alpha) with the least mean absolute error, of 0, 1/steps, ... 1; ties to the least."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps))
    d = w.select(*by, "y_true", a, b, grid.alias("alpha"))
    g = d.groupBy(*by, "alpha").agg(F.avg(F.abs(F.col(a) * F.col("alpha") + F.col(b) * (1 - F.col("alpha")) - F.col("y_true"))).alias("mae"))
    return g.groupBy(*by).agg(F.min_by("alpha", F.struct(F.round("mae", 9), "alpha")).alias("alpha"), F.min("mae").alias("mae"))


def bias_calibration(predictions: DataFrame, fit: Column, by: Sequence[str], prior: float = 12.0, limit: float = 1.0) -> DataFrame:
    """y_pred plus its group's mean residual on fitting rows, shrunk by n / (n + prior) and clipped; unseen groups keep y_pred."""
    g = predictions.where(fit).groupBy(*by).agg(F.avg(F.col("y_true") - F.col("y_pred")).alias("_r"), F.count("*").alias("_n"))
    g = g.select(*by, clip(F.col("_r") * F.col("_n") / (F.col("_n") + prior), -limit, limit).alias("bias"))
    d = predictions.join(g, list(by), "left")
    return d.withColumn("y_cal", F.col("y_pred") + F.coalesce("bias", F.lit(0.0)))


def quantile_map(predictions: DataFrame, fit: Column, by: Sequence[str], points: int = 20, alpha: float = 1.0) -> DataFrame:
    """Predictions moved from their quantiles on fitting rows to those of the truth, linear between `points` + 1 knots, blended by alpha."""
    qs = F.array(*[F.lit(i / points) for i in range(points + 1)])
    knots = predictions.where(fit).groupBy(*by).agg(F.percentile("y_pred", qs).alias("_p"), F.percentile("y_true", qs).alias("_t"))
    d = predictions.join(knots, list(by), "left")
    k = F.size(F.filter("_p", lambda x: x <= F.col("y_pred")))
    k = clip(k, 1, points)
    lo, hi = F.element_at("_p", k), F.element_at("_p", k + 1)
    tlo, thi = F.element_at("_t", k), F.element_at("_t", k + 1)
    share = clip(F.when(hi > lo, (F.col("y_pred") - lo) / (hi - lo)).otherwise(F.lit(0.0)), 0.0, 1.0)
    mapped = tlo + share * (thi - tlo)
    return d.withColumn("y_cal", F.coalesce((1 - alpha) * F.col("y_pred") + alpha * mapped, F.col("y_pred"))).drop("_p", "_t")


def monotone_projection(predictions: DataFrame, base: Column, alpha: float = 1.0, extra: Sequence[str] = ("model",)) -> DataFrame:
    """Along the horizon, changes from base never turn back: the running extreme in the direction of the last step's change."""
    by = ["site_id", "start", "node_index", *extra]
    w = Window.partitionBy(*by).orderBy("horizon")
    d = predictions.withColumn("_c", F.col("y_pred") - base)
    sign = F.signum(F.last("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    up, down = F.max("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = F.when(sign >= 0, up).otherwise(down)
    return d.withColumn("y_proj", base + (1 - alpha) * F.col("_c") + alpha * run).drop("_c")


def simplex(parts: int, steps: int) -> list[tuple[float, ...]]:
    """All weights in steps of 1/steps that add up to 1."""

    def rest(n: int, left: int):
        if n == 1:
            yield (left,)
        else:
            for i in range(left + 1):
                for r in rest(n - 1, left - i):
                    yield (i, *r)

    return [tuple(x / steps for x in r) for r in rest(parts, steps)]


def best_stack(w: DataFrame, models: Sequence[str], by: Sequence[str], steps: int = 5) -> DataFrame:
    """The convex weights with the least mean absolute error on w; ties to the first in lexical order. One pass for the whole grid."""
    grid = F.array(*[F.array(*[F.lit(x) for x in g]) for g in simplex(len(models), steps)])
    d = w.select(*by, "y_true", *models, F.posexplode(grid).alias("i", "g"))
    mix = sum((F.col(m) * F.col("g")[k] for k, m in enumerate(models[1:], 1)), F.col(models[0]) * F.col("g")[0])
    g = d.groupBy(*by, "i").agg(F.avg(F.abs(mix - F.col("y_true"))).alias("mae"), F.first("g").alias("g"))
    best = g.groupBy(*by).agg(F.min_by("g", F.struct(F.round("mae", 9), "i")).alias("g"), F.min("mae").alias("mae"))
    return best.select(*by, *[F.col("g")[k].alias(f"w_{m}") for k, m in enumerate(models)], "mae")


def switch(official: Column, fallback: Column, is_fallback: Column) -> Column:
    return F.when(is_fallback, fallback).otherwise(official)


def event_switch(official: Column, low: Column, high: Column, is_fallback: Column, risk: Column, threshold: float, slope: float | None = None) -> Column:
    """Official samples keep their expert; fallback ones get the high-risk expert from the threshold on, or by a logistic gate."""
    if slope is None:
        return F.when(~is_fallback, official).when(risk >= threshold, high).otherwise(low)
    gate = 1 / (1 + F.exp(-slope * (risk - threshold)))
    return F.when(~is_fallback, official).otherwise(gate * high + (1 - gate) * low)


def grid_errors(w: DataFrame, by: Sequence[str], experts: Sequence[str], segment: Sequence[str]) -> DataFrame:
    """(by, segment, expert, abs_sum, n): error sums once for each expert and segment. For hard switches a grid needs no more."""
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("expert"), F.abs(F.col(m) - F.col("y_true")).alias("e")) for m in experts]))
    return w.select(*by, *segment, e.alias("x")).groupBy(*by, *segment, F.col("x.expert").alias("expert")).agg(F.sum("x.e").alias("abs_sum"), F.count("*").alias("n"))


def switch_grid(sums: DataFrame, by: Sequence[str], segment: str) -> DataFrame:
    """Mean absolute error of each pair of experts, one for rows with the segment false, one for true; from grid_errors()."""
    a = sums.where(~F.col(segment)).select(*by, F.col("expert").alias("official"), F.col("abs_sum").alias("sa"), F.col("n").alias("na"))
    b = sums.where(F.col(segment)).select(*by, F.col("expert").alias("fallback"), F.col("abs_sum").alias("sb"), F.col("n").alias("nb"))
    joined = a.join(b, list(by))  # experts times experts rows for each group
    return joined.select(*by, "official", "fallback", ((F.col("sa") + F.col("sb")) / (F.col("na") + F.col("nb"))).alias("mae"))


def teacher_weights(w: DataFrame, fallback_weight: float = 0.5, official_weight: float = 2.0) -> Column:
    return F.when(F.col("is_fallback"), fallback_weight).otherwise(official_weight)


def calibrator_probability(model_json: str, features: Sequence[Column], names: Sequence[str]) -> Column:
    """Probability of a logistic model kept as JSON; features are taken in the model's order and must all be there."""
    m = F.from_json(F.lit(model_json), "coefs array<double>, intercept double, features array<string>")
    order = F.array(*[F.lit(n) for n in names])
    checked = F.when(F.array_except(m["features"], order) == F.array().cast("array<string>"), m["intercept"]).otherwise(F.raise_error(F.lit("a feature of the model is missing")))
    values = F.map_from_arrays(order, F.array(*[F.coalesce(f.cast("double"), F.lit(0.0)) for f in features]))
    terms = F.zip_with(m["coefs"], m["features"], lambda c, n: c * F.element_at(values, n))
    return 1 / (1 + F.exp(-F.aggregate(terms, checked, lambda a, x: a + x)))
