"""Evaluation of prediction tables: errors by any grouping, overlapping segments, intervals, skill scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.common import beside, draw, drawn, with_stats


def scopes(susceptibility: DataFrame, q: float = 0.6) -> DataFrame:
    """(site_id, node_index, scope): all, rain_sensitive (positive), rain_top (from the q-quantile of positive values on). A row for each scope of a node."""
    d = with_stats(susceptibility, ["site_id"], _q=F.percentile(F.when(F.col("rain_susceptibility") > 0, F.col("rain_susceptibility")), F.lit(q)))
    s = F.col("rain_susceptibility")
    names = F.array(F.lit("all"), F.when(s > 0, F.lit("rain_sensitive")), F.when((s > 0) & (s >= F.col("_q")), F.lit("rain_top")))
    return d.select("site_id", "node_index", F.explode(F.array_compact(names)).alias("scope"))


def with_scopes(predictions: DataFrame, susceptibility: DataFrame) -> DataFrame:
    """Predictions once for each scope of their node. The node table is joined by site and node."""
    return predictions.join(scopes(susceptibility).hint("merge"), ["site_id", "node_index"])


def error_table(d: DataFrame, by: Sequence[str], true: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    e = F.col(predicted) - F.col(true)
    return d.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def regression_scores(d: DataFrame, by: Sequence[str], true: str = "y_true", predicted: str = "y_pred", floor: float = 0.1) -> DataFrame:
    """MSE, MAPE over |true| > floor, symmetric MAPE, explained variance, R2 and correlation."""
    y, p = F.col(true), F.col(predicted)
    e = p - y
    ape = F.avg(F.when(F.abs(y) > floor, F.abs(e) / F.abs(y)))
    smape = F.avg(F.when(F.abs(y) + F.abs(p) > 1e-9, 2 * F.abs(e) / (F.abs(y) + F.abs(p))))
    return d.groupBy(*by).agg(F.avg(e * e).alias("mse"), ape.alias("masked_mape"), smape.alias("smape"), (1 - F.var_pop(e) / F.var_pop(y)).alias("explained_variance"), (1 - F.avg(e * e) / F.var_pop(y)).alias("r2"), F.corr(y, p).alias("pearson"))


def gain(reference: Column, model: Column) -> Column:
    """100 * (ref - m) / max(ref, 1e-6); null where either is missing."""
    return F.when(reference.isNotNull() & model.isNotNull(), 100 * (reference - model) / F.greatest(reference, F.lit(1e-6)))


def auc(d: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks, and the Brier score. Ranks come from counts of equal scores, so ties in a
    large group are one row each; null where a group has one kind of label only."""
    g = d.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"), F.sum((F.col(score) - F.col(label)) ** 2).alias("_b"))
    w = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_r", F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2)
    t = g.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_p")).alias("r"), F.sum("_p").alias("p"), F.sum("_n").alias("n"), F.sum("_b").alias("b"))
    return t.select(*by, F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"), (F.col("b") / F.col("n")).alias("brier"))


def ssim(d: DataFrame, by: Sequence[str], order: str, true: str, predicted: str, width: int = 7, span: float = 1.0) -> DataFrame:
    """Mean structural similarity along `order` within each group, over full windows of `width`; constants for a value range of `span`."""
    half, c1, c2 = width // 2, (0.01 * span) ** 2, (0.03 * span) ** 2
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    x, y = F.col(true), F.col(predicted)
    m = lambda c: F.avg(c).over(w)
    k = width / (width - 1)
    d = d.select(*by, F.count("*").over(w).alias("n"), m(x).alias("mx"), m(y).alias("my"), m(x * x).alias("xx"), m(y * y).alias("yy"), m(x * y).alias("xy")).where(F.col("n") == width)
    vx, vy, vxy = k * (F.col("xx") - F.col("mx") ** 2), k * (F.col("yy") - F.col("my") ** 2), k * (F.col("xy") - F.col("mx") * F.col("my"))
    s = (2 * F.col("mx") * F.col("my") + c1) * (2 * vxy + c2) / ((F.col("mx") ** 2 + F.col("my") ** 2 + c1) * (vx + vy + c2))
    return d.groupBy(*by).agg(F.avg(s).alias("ssim"))


def bootstrap_mean(d: DataFrame, by: Sequence[str], value: str, order: Sequence[str], draws: int = 100, seed: int = 7) -> DataFrame:
    """Mean and the 5 and 95 percentiles of resampled means (a 90 % interval) of each group; of fewer than five values the mean thrice.

    Draws are fixed arithmetic on (draw, position), so any engine gives the same ones. Groups are of samples, not of rows.
    """
    numbered = d.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).select(*by, "_i", F.col(value).alias("_v"))
    n = numbered.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("_v").alias("mean"))
    picks = n.where("_n >= 5").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")))).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    picks = picks.select(*by, "_b", draw(F.col("_b"), F.col("_k"), seed, F.col("_n")).cast("int").alias("_i"))
    # a hundred draws of every value look as small as a row for each group to the planner, which would broadcast them
    means = picks.hint("merge").join(numbered, [*by, "_i"]).groupBy(*by, "_b").agg(F.avg("_v").alias("_m"))
    spread = means.groupBy(*by).agg(F.percentile("_m", F.lit(0.05)).alias("lo"), F.percentile("_m", F.lit(0.95)).alias("hi"))
    return n.join(spread, list(by), "left").select(*by, F.col("_n").alias("n"), "mean", F.coalesce("lo", "mean").alias("lo"), F.coalesce("hi", "mean").alias("hi"))


def bootstrap_means(d: DataFrame, by: Sequence[str], values: Sequence[str], order: Sequence[str], draws: int = 100, seed: int = 7) -> DataFrame:
    """(by, value, n, mean, lo, hi): bootstrap_mean() of each column of `values` over its known rows, for large groups.

    A group's rows come to a task in their order and stay there as plain numbers, 8 bytes a value; a draw is a sum over
    them, never rows. Columns that are known for equally many rows share their draws.
    """
    kinds = dict(d.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", value string, n long, mean double, lo double, hi double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def rows() -> pa.RecordBatch:
            known = {v: np.concatenate([x[i][m[i]] for x, m in held]) for i, v in enumerate(values)}
            known = {v: x for v, x in known.items() if len(x)}
            means = resampled_means(list(known.values()), draws, seed)
            cols = [pa.array([k.as_py()] * len(known), k.type) for k in key]
            numbers = [[len(x) for x in known.values()], [float(x.mean()) for x in known.values()]]
            bounds = [np.quantile(m, (0.05, 0.95)).tolist() if len(m) else [x.mean()] * 2 for m, x in zip(means, known.values(), strict=True)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(list(known), pa.string()), pa.array(numbers[0], pa.int64()), *[pa.array(x, pa.float64()) for x in (numbers[1], *zip(*bounds, strict=True))]], names=[*by, "value", "n", "mean", "lo", "hi"])

        for batch in batches:
            k = [batch.column(i) for i in range(len(by))]
            x = np.stack([batch.column(len(by) + i).to_numpy(zero_copy_only=False) for i in range(len(values))]).astype(float)
            known = np.stack([np.asarray(batch.column(len(by) + i).is_valid()) for i in range(len(values))])
            ids = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in k]
            first = np.flatnonzero(np.concatenate([[True], np.any([i[1:] != i[:-1] for i in ids], axis=0)])) if batch.num_rows else []
            for a, b in zip(first, [*first[1:], batch.num_rows], strict=True):
                now = [c[int(a)] for c in k]
                if key is not None and [c.as_py() for c in now] != [c.as_py() for c in key]:
                    yield rows()
                    held = []
                key = now
                held.append((x[:, a:b], known[:, a:b]))
        if held:
            yield rows()

    s = d.select(*by, *order, *[F.col(v).cast("double").alias(v) for v in values]).repartition(*by).sortWithinPartitions(*by, *order)
    return s.select(*by, *values).mapInArrow(task, schema)


def resampled_means(values: Sequence[np.ndarray], draws: int, seed: int, block: int = 1 << 20) -> list[np.ndarray]:
    """The means of each array's drawn items, one for each draw; none of fewer than five. Arrays of a length share their draws."""
    out = [np.zeros(draws if len(x) >= 5 else 0) for x in values]
    for n in {len(x) for x in values if len(x) >= 5}:
        same = [i for i, x in enumerate(values) if len(x) == n]
        for first in range(0, n, block):
            item = np.arange(first, min(first + block, n), dtype=np.int64)
            for b in range(draws):
                at = drawn(np.int64(b), item, seed, n)
                for i in same:
                    out[i][b] += values[i][at].sum()
        for i in same:
            out[i] /= n
    return out


def average_ranks(d: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Ranks from 1, ties share their mean."""
    w = Window.partitionBy(*by)
    return d.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def spearman(d: DataFrame, by: Sequence[str], x: str, y: str, least: int = 8) -> DataFrame:
    """(by, n, rho): correlation of average ranks of each group with at least `least` rows where both are known."""
    d = d.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_ranks(average_ranks(d, by, x, "_rx"), by, y, "_ry")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho")).where(F.col("n") >= least)


def permutation_p(d: DataFrame, by: Sequence[str], x: str, y: str, order: str, permutations: int = 50, seed: int = 7) -> DataFrame:
    """(by, rho, p): Spearman's rho and (#{|permuted| >= |rho|} + 1) / (P + 1). Shuffles are a fixed order by arithmetic."""
    r = average_ranks(average_ranks(d, by, x, "_rx"), by, y, "_ry").withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))
    r = r.select(*by, "_i", "_rx", "_ry")
    e = r.withColumn("_perm", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(permutations).cast("long"))))
    e = e.withColumn("_to", F.row_number().over(Window.partitionBy(*by, "_perm").orderBy(draw(F.col("_perm"), F.col("_i"), seed, 65521), "_i")).cast("long"))
    x1, y1 = e.select(*by, "_perm", "_i", "_rx"), e.select(*by, "_perm", F.col("_to").alias("_i"), "_ry")
    rho = x1.join(y1, [*by, "_perm", "_i"]).groupBy(*by, "_perm").agg(F.round(F.corr("_rx", "_ry"), 9).alias("_r"))
    own = r.groupBy(*by).agg(F.round(F.corr("_rx", "_ry"), 9).alias("rho"))
    return rho.join(own, list(by)).groupBy(*by, "rho").agg(((F.count(F.when(F.abs("_r") >= F.abs("rho"), 1)) + 1) / (permutations + 1)).alias("p"))


def high_low_contrast(d: DataFrame, by: Sequence[str], x: str, response: str) -> DataFrame:
    """Mean response where x is at least its 0.9-quantile and where at most its median; difference and ratio."""
    d = with_stats(d, by, _hi=F.percentile(x, F.lit(0.9)), _lo=F.percentile(x, F.lit(0.5)))
    g = d.groupBy(*by).agg(F.avg(F.when(F.col(x) >= F.col("_hi"), F.col(response))).alias("high"), F.avg(F.when(F.col(x) <= F.col("_lo"), F.col(response))).alias("low"))
    return g.withColumn("delta", F.col("high") - F.col("low")).withColumn("lift", F.col("high") / F.greatest("low", F.lit(1e-6)))


def node_response(events: DataFrame, change_points: DataFrame, nodes: DataFrame, first_day, days: int, permutations: int = 20, seed: int = 7) -> DataFrame:
    """Change points of each node within the windows after events, against windows that begin on drawn days.

    events: site_id, threshold_level, lag_days, date (windows of lag_days from date on; one change point counts once).
    Returns site_id, threshold_level, lag_days, profile, node_index, observed, baseline, lift, p_value, for all nodes:
    zero counts count. A site's windows meet its change points and nodes in one group, whose drawn windows are never rows:
    a change point is hit if a window begins on one of the lag_days days before it, or on its own.
    """
    keys = ["site_id", "threshold_level", "lag_days"]
    day = F.datediff("date", F.lit(first_day).cast("date")).alias("day")
    kinds = dict(events.dtypes) | {f"node_{k}": v for k, v in nodes.dtypes}
    c = change_points.select(F.col("site_id").alias("_site"), "node_index", "profile", day).where("profile is not null and day is not null")
    c = c.unionByName(nodes.select(F.col("site_id").alias("_site"), "node_index"), allowMissingColumns=True).where("_site is not null and node_index is not null")
    kind = "int64" if kinds["node_node_index"] in ("bigint", "int", "smallint", "tinyint") else "object"
    counts = ["observed", "_sum", "_reached"]
    columns = [*keys, "profile", "node_index", *counts]
    profiles = ["strict", "medium"]

    def task(key, e, c):
        listed = c["profile"].isna().to_numpy()
        own, c = c["node_index"][listed].to_numpy().astype(kind), c[~listed]
        if not len(e) or not len(own):
            return pd.DataFrame(columns=columns)
        # places of the change points among profiles and nodes, of which only those that are listed count
        node, order = np.unique(own), np.argsort(own, kind="stable")
        at = c["node_index"].to_numpy().astype(kind)
        place, profile = np.searchsorted(node, at), c["profile"].map({n: k for k, n in enumerate(profiles)}).to_numpy(float)
        known = (node[np.minimum(place, len(node) - 1)] == at) & ~np.isnan(profile)
        group, days_hit = (profile[known] * len(node) + place[known]).astype(np.int64), c["day"].to_numpy(np.int64)[known]
        sort = np.argsort(group, kind="stable")
        group, days_hit = group[sort], days_hit[sort]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        level, names = pd.factorize(e["threshold_level"])
        lag, begins = e["lag_days"].to_numpy(np.int64), e["day"].to_numpy(np.int64)
        rows = []
        for k in np.unique(lag):
            there = lag == k
            which = [i for i in range(len(names)) if (there & (level == i)).any()]
            found = hits_of_groups([begins[there & (level == i)] for i in which], days_hit, first, int(k), days, permutations, seed)
            for i, f in zip(which, zip(*found, strict=True), strict=True):
                # nodes without a change point: no hits, and no fewer in all permutations
                table = np.repeat([[0], [0], [permutations]], len(profiles) * len(node), axis=1)
                table[:, group[first]] = f
                rows.append((names[i], int(k), table.reshape(3, len(profiles), -1)[:, :, np.searchsorted(node, own)].reshape(3, -1)))
        n = len(profiles) * len(own)
        numbers = np.concatenate([r[2] for r in rows], axis=1)
        labels = {"site_id": key[0], "threshold_level": np.repeat(np.array([r[0] for r in rows], object), n), "lag_days": np.repeat([r[1] for r in rows], n)}
        return pd.DataFrame(labels | {"profile": np.tile(np.repeat(np.array(profiles, object), len(own)), len(rows)), "node_index": np.tile(own, len(profiles) * len(rows))} | dict(zip(counts, numbers, strict=True)))[columns]

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", profile string, node_index {kinds['node_node_index']}, observed long, _sum long, _reached long"
    e = events.select(*keys, day).where("site_id is not null and threshold_level is not null and lag_days is not null and day is not null")
    d = e.groupBy("site_id").cogroup(c.groupBy("_site")).applyInPandas(task, schema)
    base = F.col("_sum") / permutations
    return d.select(*keys, "profile", "node_index", "observed", base.alias("baseline"), (F.col("observed") / F.greatest(base, F.lit(1e-6))).alias("lift"), ((F.col("_reached") + 1) / (permutations + 1)).alias("p_value"))


@lru_cache(maxsize=64)
def drawn_days(most: int, lag: int, days: int, permutations: int, seed: int) -> np.ndarray:
    """For each day and permutation the first of its `most` drawn windows that holds the day, from 1; `most` + 1 if none does.

    Drawn windows don't depend on how many are drawn, so the days that n of them hold are those whose first is at most n.
    A row more stands for days that no window can hold. A table of 300 permutations of seven years takes 1.5 MB.
    """
    span = days - lag
    perm, item = np.arange(1, permutations + 1)[:, None], np.arange(1, most + 1)[None, :]
    at = drawn(perm, item, seed, span)
    first = np.full((permutations, days + 1), most + 1, np.uint16 if most < 65_535 else np.int64)
    np.minimum.at(first, (perm - 1, at), item.astype(first.dtype))
    width = 1
    while width <= lag:  # the least of the days up to `lag` before, by doubling
        step = min(width, lag + 1 - width)
        first[:, step:days] = np.minimum(first[:, step:days], first[:, : days - step])
        width += step
    return np.ascontiguousarray(first.T)


def hits_of_groups(begins: Sequence[np.ndarray], day: np.ndarray, first: np.ndarray, lag: int, days: int, permutations: int, seed: int, block: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of windows' first days and each group of change points, which begin at the places `first` of `day`:
    change points hit, hits of as many drawn windows over all permutations, and in how many permutations these are as many."""
    ends = np.append(first[1:], len(day))
    drawn_on = {len(b): drawn_days(1 << max(6, (len(b) - 1).bit_length()), lag, days, permutations, seed) for b in begins}
    inside = np.where((day >= 0) & (day < days), day, days)  # no drawn window holds other days
    observed, total, reached = np.zeros((3, len(begins), len(first)), np.int64)
    longest = int((ends - first).max(initial=0))
    small = np.uint8 if longest < 256 else np.uint16 if longest < 65_536 else np.int64
    for k, b in enumerate(begins):
        b = np.sort(b)
        own = np.searchsorted(b, day, "right") > np.searchsorted(b, day - lag, "left")
        observed[k] = np.add.reduceat(own, first, dtype=np.int64) if len(first) else 0
    i = 0
    while i < len(first):  # whole groups, about `block` change points at once
        j = max(i + 1, int(np.searchsorted(ends, first[i] + block, "right")))
        part = slice(first[i], ends[j - 1])
        rows = {id(t): t[inside[part]] for t in drawn_on.values()}
        for k, b in enumerate(begins):
            hit = (rows[id(drawn_on[len(b)])] <= len(b)).view(np.uint8)
            hits = np.add.reduceat(hit, first[i:j] - first[i], axis=0, dtype=small)
            total[k, i:j], reached[k, i:j] = hits.sum(axis=1, dtype=np.int64), (hits >= observed[k, i:j, None].astype(small)).sum(axis=1)
        i = j
    return observed, total, reached


def drawn_hits(begins: np.ndarray, c: pd.DataFrame, lag: int, days: int, permutations: int, seed: int, block: int = 20_000) -> dict[str, np.ndarray]:
    """hits_of_groups() of each profile and node of c (day, profile, node_index), for the windows that begin on the days `begins`."""
    c = c.sort_values(["profile", "node_index"], kind="stable")
    first = np.flatnonzero(~c.duplicated(["profile", "node_index"]).to_numpy())
    found = hits_of_groups([begins], c["day"].to_numpy(), first, lag, days, permutations, seed, block)
    return {"profile": c["profile"].to_numpy()[first], "node_index": c["node_index"].to_numpy()[first]} | {n: x[0] for n, x in zip(("observed", "_sum", "_reached"), found, strict=True)}


def susceptibility_scores(response: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site_id, node_index, rain_susceptibility_dense): mean log lift, mean -log10 p and most hits, each scaled, weighted .45, .35, .20; 0 for nodes without evidence."""
    lift, p = F.log1p(F.greatest("lift", F.lit(0.0))), -F.log10(F.greatest("p_value", F.lit(1e-6)))
    # the windows' sums first, then the node's; one pass over the response
    sums = {f"{k}{n}": f(x) for n, x in (("a", lift), ("b", p)) for k, f in (("_s", F.sum), ("_n", F.count))}
    w = response.groupBy("site_id", "node_index", "threshold_level", "lag_days").agg(F.sum((F.col("p_value") < 0.1).cast("int")).alias("_h"), *[x.alias(n) for n, x in sums.items()])
    g = w.groupBy("site_id", "node_index").agg(*[(F.sum(f"_s{n}") / F.sum(f"_n{n}")).alias(n) for n in "ab"], F.max("_h").cast("double").alias("c"))
    stats = {f"_{k}{c}": (F.min if k == "lo" else F.max)(c) for c in "abc" for k in ("lo", "hi")}
    d = beside(g, ["site_id"], **stats)
    scaled = lambda c: F.when(F.col(f"_hi{c}") - F.col(f"_lo{c}") < 1e-6, 0.0).otherwise((F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}")))
    d = d.select("site_id", "node_index", (0.45 * scaled("a") + 0.35 * scaled("b") + 0.20 * scaled("c")).alias("_v"))
    return nodes.select("site_id", "node_index").join(d, ["site_id", "node_index"], "left").select("site_id", "node_index", F.coalesce("_v", F.lit(0.0)).alias("rain_susceptibility_dense"))


def near_duplicates(w: DataFrame, models: Sequence[str]) -> DataFrame:
    """(a, b, same) of all pairs of model columns: equal within 1e-8 + 1e-5 of the second in every row."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    cols = [F.max(F.abs(F.col(a) - F.col(b)) - (1e-8 + 1e-5 * F.abs(F.col(b)))).alias(f"{a}|{b}") for a, b in pairs]
    row = w.agg(*cols)
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"`{a}|{b}`") <= 0).alias("same")) for a, b in pairs])).alias("x")).select("x.*")


def neighbours(queries: DataFrame, pool: DataFrame, by: Sequence[str], features: Sequence[str], k: int, causal: str | None = None) -> DataFrame:
    """(by, query, neighbour, distance, rank): the k nearest pool rows of the same group by features standardised over the pool.

    Both sides have the column `key`; ties go to the smaller one. With `causal`, neighbours are strictly earlier in that
    column. Groups are sites: a query meets the rows of its own site only.
    """
    stats = pool.groupBy(*by).agg(*[F.avg(f).alias(f"_m{f}") for f in features], *[F.stddev_pop(f).alias(f"_s{f}") for f in features])
    unit = lambda d: d.join(stats.hint("merge"), list(by)).withColumns({f: (F.col(f) - F.col(f"_m{f}")) / F.when(F.col(f"_s{f}") >= 1e-6, F.col(f"_s{f}")).otherwise(1.0) for f in features}).drop(*[f"_{c}{f}" for f in features for c in "ms"])
    more = [causal] if causal else []
    q = unit(queries).select(*by, F.col("key").alias("query"), *[F.col(f).alias(f"q_{f}") for f in [*features, *more]])
    p = unit(pool).select(*by, F.col("key").alias("neighbour"), *[F.col(f).alias(f"p_{f}") for f in [*features, *more]])
    d = q.join(p.hint("merge"), list(by)).where("query != neighbour")
    if causal:
        d = d.where(F.col(f"p_{causal}") < F.col(f"q_{causal}"))
    dist = F.sqrt(sum(((F.col(f"q_{f}") - F.col(f"p_{f}")) ** 2 for f in features[1:]), (F.col(f"q_{features[0]}") - F.col(f"p_{features[0]}")) ** 2))
    d = d.withColumn("distance", dist).withColumn("rank", F.row_number().over(Window.partitionBy(*by, "query").orderBy(F.round("distance", 9), "neighbour")))
    return d.where(F.col("rank") <= k).select(*by, "query", "neighbour", "distance", "rank")


def inverse_distance(n: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weights 1 / max(distance, 1e-6), adding up to 1 for each query."""
    raw = 1 / F.greatest("distance", F.lit(1e-6))
    return n.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy(*by, "query")))


def softmax(c: Column, by: Sequence[str], temperature: float) -> Column:
    """exp(c / temperature), adding up to 1 within each group."""
    w = Window.partitionBy(*by)
    e = F.exp((c - F.max(c).over(w)) / temperature)
    return e / F.sum(e).over(w)
