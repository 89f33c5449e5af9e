"""Searches over parameters whose candidates share their work: sums are taken once, and every setting is read off them.

Squared errors of a setting that is linear in the predictions follow from moments; errors of hard thresholds from
running sums over bins of the risk; neighbourhoods of all sizes from one ranked list. Only absolute errors of mixtures
need a pass over the rows, which is one pass for all settings: each task adds up a vector of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.common import clip, with_stats
from slopewatch.operators.evaluate import neighbours, softmax


def summed(d: DataFrame, by: Sequence[str], size: int, columns: Callable[[pd.DataFrame], Iterator[np.ndarray]], rows_of: str | None = None) -> DataFrame:
    """(by, i, total, n): of each group, the sums of `size` numbers that `columns` makes of its rows (one array for each number).

    Every task adds up its own rows and emits one row for each of its groups; the vectors are added after the exchange.
    NaN counts as 0. n counts the rows, or adds up the column `rows_of` where a row stands for several.
    """
    kinds = dict(d.dtypes)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        rows: dict[tuple, int] = {}
        for b in batches:
            if not len(b):
                continue
            grouped = b.groupby(list(by), sort=False, dropna=False)
            code = grouped.ngroup().to_numpy()
            keys = [k if isinstance(k, tuple) else (k,) for k in b.loc[~pd.Series(code, index=b.index).duplicated(), list(by)].itertuples(index=False, name=None)]
            totals = np.empty((len(keys), size))
            for i, column in enumerate(columns(b)):
                totals[:, i] = np.bincount(code, np.nan_to_num(column), len(keys))
            counts = np.bincount(code, None if rows_of is None else b[rows_of].to_numpy(), minlength=len(keys))
            for key, total, n in zip(keys, totals, counts.tolist(), strict=True):
                held[key] = held.get(key, 0) + total
                rows[key] = rows.get(key, 0) + int(n)
        if held:
            out = pd.DataFrame(list(held), columns=list(by))
            yield out.assign(totals=[v.tolist() for v in held.values()], n=list(rows.values()))

    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", totals array<double>, n long"
    part = d.mapInPandas(task, schema)
    return part.select(*by, "n", F.posexplode("totals").alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("total"), F.sum("n").alias("n"))


def labelled(names: Sequence[str], settings: Sequence[tuple]) -> Column:
    """An array of structs of the settings (strings, whole numbers, doubles), to be indexed by their number."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else repr(v)
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {text(v)}" for n, v in zip(names, s, strict=True)) + ")" for s in settings) + ")")


# expanding folds


def with_speeds(panel: DataFrame, ks: Sequence[int]) -> DataFrame:
    """panel with `speeds`: for each k, the mean of the last k - 1 differences, null where the history is shorter."""
    w = Window.partitionBy("site_id", "node_index").orderBy("t")
    return panel.withColumn("speeds", F.array(*[(F.col("disp") - F.lag("disp", k - 1).over(w)) / (k - 1) for k in ks]))


def rolling_rows(cells: DataFrame, panel: DataFrame, n_his: int, ks: Sequence[int], model: str = "trend") -> DataFrame:
    """moving_cells() of any cells: the speeds at their origins are joined to them from the panel."""
    speed = with_speeds(panel, ks).select("site_id", "node_index", (F.col("t") - n_his + 1).alias("start"), "speeds")
    return moving_cells(cells.join(speed, ["site_id", "node_index", "start"]), model)


def moving_cells(cells: DataFrame, model: str = "trend") -> DataFrame:
    """Cells with what the rolling search needs: last, u and v (changes of the model and the truth from it), z (for each k, horizon times the mean of the last k - 1 differences).

    cells: site_id, start, horizon, node_index, y_true, persistence, the model and the `speeds` of with_speeds() at
    their origin. Cells whose history is shorter than the largest k have no row.
    """
    z = F.transform("speeds", lambda r: r * F.col("horizon"))
    d = cells.where(~F.exists("speeds", F.isnull))
    return d.withColumns({"u": F.col(model) - F.col("persistence"), "v": F.col("y_true") - F.col("persistence"), "z": z}).drop("speeds")


def rolling_search(rows: DataFrame, by: Sequence[str], samples: int, first: int, ks: Sequence[int], alphas: Sequence[float], shrinks: Sequence[float], folds: int = 4, limit: float = 1.5) -> DataFrame:
    """Damped velocities (k, alpha) corrected by shrunken gains of each node, chosen by expanding folds.

    rows: rolling_rows() with `split`; the `samples` validation samples from start `first` on are cut into folds + 1
    blocks, and fold f fits each node's gain (least squares of the truth's change on the model's, both from the damped
    velocity, clipped to +-limit) on blocks up to f and scores block f + 1; samples beyond the last block fit the final
    gain only. Returns by, k, alpha, shrink, cv_rmse, cv_mae (means over the folds), test_rmse, test_mae (by the gain of
    all validation samples), mean_gain. Gains and squared errors come from moments of each node; absolute errors from
    the cells of a node's block, which travel as one row with the block's gains, so that no gain is repeated for a cell
    and all errors take one pass.
    """
    node = [*by, "site_id", "node_index"]
    size = max(1, samples // (folds + 1))
    block = F.when(F.col("split") == "test", folds + 2).otherwise(F.least(F.floor((F.col("start") - first) / size), F.lit(folds + 1))).cast("int")
    d = rows.where("split in ('val', 'test')").withColumn("_b", block)
    pairs = list(product(range(len(ks)), alphas))
    z = [F.col("z")[i] for i in range(len(ks))]
    sums = {"n": F.count("*"), "uu": F.sum(F.col("u") ** 2), "uv": F.sum(F.col("u") * F.col("v")), "vv": F.sum(F.col("v") ** 2)}
    for i, x in enumerate(z):
        sums |= {f"uz{i}": F.sum(F.col("u") * x), f"vz{i}": F.sum(F.col("v") * x), f"zz{i}": F.sum(x * x)}
    # the truth may be unknown: NaN keeps its place in the list
    cell = F.array(*[F.coalesce(c, F.lit(float("nan"))).cast("double") for c in (F.col("u"), F.col("v"), *z)])
    m = d.groupBy(*node, "_b").agg(*[c.alias(n) for n, c in sums.items()], F.flatten(F.collect_list(cell)).alias("_cells"))
    # what each fold is fitted on: all blocks before the scored one; the test block follows all of validation
    past = Window.partitionBy(*node).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    m = m.select(*node, "_b", "_cells", *sums, *[F.coalesce(F.sum(n).over(past), F.lit(0)).alias(f"f_{n}") for n in sums]).where(f"_b between 1 and {folds} or _b = {folds + 2}")

    def products(get: Callable, i, a) -> tuple:
        """Sums of changes from last + alpha * z: those of the model times the truth's, and the squares of each."""
        zz = a * a * get("zz", i)
        return get("uv") - a * (get("uz", i) + get("vz", i)) + zz, get("uu") - 2 * a * get("uz", i) + zz, get("vv") - 2 * a * get("vz", i) + zz

    fitted = {n: F.array(*[F.col(f"f_{n}{i}") for i in range(len(ks))]) for n in ("uz", "vz", "zz")}

    def gain(x: Column) -> Column:
        pt, pp, _ = products(lambda n, i=None: F.col(f"f_{n}") if i is None else F.get(fitted[n], i), x["i"], x["a"])
        return clip(pt / (pp + 1e-6), -limit, limit)

    m = m.withColumn("_g", F.transform(labelled(["i", "a"], [(i, float(a)) for i, a in pairs]), gain))
    settings = [(int(ks[i]), float(a), float(s)) for i, a in pairs for s in shrinks]

    def errors(b: pd.DataFrame) -> Iterator[np.ndarray]:
        """Squared errors of all settings, their shrunken gains, their absolute errors, and the count of the nodes."""
        g = np.stack(b["_g"].to_numpy()).T
        for j, (i, a) in enumerate(pairs):
            pt, pp, tt = products(lambda n, i=None: b[n if i is None else f"{n}{i}"].to_numpy(), i, a)
            for s in shrinks:
                yield tt - 2 * s * g[j] * pt + s * s * g[j] ** 2 * pp
        for j in range(len(pairs)):
            for s in shrinks:
                yield s * g[j]
        count = b["n"].to_numpy()
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        u, v, *zs = np.ascontiguousarray(np.concatenate(b["_cells"].to_list()).reshape(-1, 2 + len(ks)).T)
        known = np.isfinite(u + v + sum(zs)).all()
        e = np.empty(len(u))
        for j, (i, a) in enumerate(pairs):
            rest, move = v - a * zs[i], np.repeat(g[j], count) * (u - a * zs[i])
            for s in shrinks:
                np.abs(np.subtract(rest, np.multiply(move, s, out=e), out=e), out=e)
                yield np.add.reduceat(e if known else np.nan_to_num(e), first)
        yield np.ones(len(b))

    many = len(settings)
    total = summed(m.select(*by, "_b", *sums, "_g", "_cells"), [*by, "_b"], 3 * many + 1, errors, "n")
    nodes = F.max(F.when(F.col("i") == 3 * many, F.col("total"))).over(Window.partitionBy(*by, "_b"))  # a row for each setting and block
    part = lambda k: F.max(F.when(F.floor(F.col("i") / many) == k, F.col("total")))
    e = total.withColumn("_nodes", nodes).where(F.col("i") < 3 * many).groupBy(*by, "_b", (F.col("i") % many).alias("i")).agg(part(0).alias("sse"), (part(1) / F.max("_nodes")).alias("gain"), (part(2) / F.max("n")).alias("mae"), F.max("n").alias("n"))
    e = e.withColumn("rmse", F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / F.col("n")))
    test = F.col("_b") == folds + 2
    pick = lambda c, on: F.avg(F.when(on, F.col(c)))
    out = e.groupBy(*by, "i").agg(pick("rmse", ~test).alias("cv_rmse"), pick("mae", ~test).alias("cv_mae"), pick("rmse", test).alias("test_rmse"), pick("mae", test).alias("test_mae"), pick("gain", test).alias("mean_gain"))
    return out.withColumn("x", labelled(["k", "alpha", "shrink"], settings)[F.col("i")]).select(*by, "x.*", "cv_rmse", "cv_mae", "test_rmse", "test_mae", "mean_gain")


# switches by source and event


def hard_switches(w: DataFrame, by: Sequence[str], experts: Sequence[str], risk: str, thresholds: Sequence[float], scope: str = "scope") -> DataFrame:
    """(by, scope, official, event, calm, threshold, mae): every triple of experts at every threshold.

    w: is_fallback, y_true, the experts, `risk` and `scope`. Official rows take their expert, fallback rows the event
    expert from the threshold on and the calm one below (a null or NaN risk is below all). Rows are added up once by the bin
    of their risk; running sums over the bins (one more than thresholds) give both sides of every threshold.
    """
    cuts = sorted(float(x) for x in thresholds)
    known = F.when(~F.isnan(F.col(risk).cast("double")), F.col(risk).cast("double"))
    bin_ = F.when(~F.col("is_fallback"), -1).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.coalesce(known >= c, F.lit(False)))))
    errors = [F.sum(F.abs(F.col(m) - F.col("y_true"))).alias(f"e_{m}") for m in experts]
    bins = w.groupBy(*by, scope, bin_.alias("_b")).agg(F.count("*").alias("n"), *errors)
    key = [*by, scope]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("expert"), F.col(f"e_{m}").alias("e")) for m in experts]))
    long = bins.select(*key, "_b", "n", each.alias("x")).select(*key, "_b", "n", "x.*")
    official = long.where("_b = -1").select(*key, F.col("expert").alias("official"), F.col("e").alias("_eo"), F.col("n").alias("_no"))
    # the sum of the bins from threshold t on, and of those below it: a row for each threshold, also where bins are empty
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("t"), F.lit(c).alias("threshold")) for i, c in enumerate(cuts)]))
    run = long.where("_b >= 0").withColumn("s", steps).select(*key, "expert", "s.*", "_b", "e", "n")
    run = run.groupBy(*key, "expert", "threshold").agg(F.sum(F.when(F.col("_b") >= F.col("t"), F.col("e")).otherwise(0.0)).alias("_hi"), F.sum(F.when(F.col("_b") < F.col("t"), F.col("e")).otherwise(0.0)).alias("_lo"), F.sum("n").alias("_nf"))
    event = run.select(*key, "threshold", F.col("expert").alias("event"), "_hi", "_nf")
    calm = run.select(*key, "threshold", F.col("expert").alias("calm"), "_lo")
    names = w.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in experts])).alias("_m"))
    grid = bins.select(*key).distinct()
    for n in ("official", "event", "calm"):
        grid = grid.join(F.broadcast(names.withColumnRenamed("_m", n)))  # a row for each expert
    grid = grid.withColumn("threshold", F.explode(F.array(*[F.lit(c) for c in cuts])))
    d = grid.join(official, [*key, "official"], "left").join(event, [*key, "threshold", "event"], "left").join(calm, [*key, "threshold", "calm"], "left")
    zero = d.fillna(0, ["_eo", "_no", "_hi", "_lo", "_nf"])
    return zero.select(*key, "official", "event", "calm", "threshold", ((F.col("_eo") + F.col("_hi") + F.col("_lo")) / (F.col("_no") + F.col("_nf"))).alias("mae"))


def soft_switches(w: DataFrame, by: Sequence[str], experts: Sequence[str], risk: str, wetness: str, gates: Sequence[tuple[float, float, float]], scope: str = "scope") -> DataFrame:
    """(by, scope, official, event, calm, coef_prob, coef_wetness, bias, mae): every triple of experts under every logistic gate.

    The gate of a fallback row is 1 / (1 + exp(-(coef_prob * risk + coef_wetness * wetness + bias))), nulls counting as
    0; it mixes the event expert with the calm one. Official rows don't depend on the gate and are added up once; one
    pass over the fallback rows serves all gates and pairs.
    """
    key = [*by, scope]
    pairs = [(a, b) for a in experts for b in experts]
    settings = [(a, b, *map(float, g)) for g in gates for a, b in pairs]
    o = w.where(~F.col("is_fallback")).groupBy(*key).agg(F.count("*").alias("_no"), *[F.sum(F.abs(F.col(m) - F.col("y_true"))).alias(f"o_{m}") for m in experts])

    def mixed(b: pd.DataFrame) -> Iterator[np.ndarray]:
        rest = {m: b[m].to_numpy(float) - b["y_true"].to_numpy(float) for m in experts}
        r, wet = np.nan_to_num(b[risk].to_numpy(float)), np.nan_to_num(b[wetness].to_numpy(float))
        for p, q, bias in gates:
            gate = 1 / (1 + np.exp(-np.clip(p * r + q * wet + bias, -500, 500)))
            for m, n in pairs:
                yield np.abs(gate * rest[m] + (1 - gate) * rest[n])

    f = summed(w.where("is_fallback").select(*key, risk, wetness, "y_true", *experts), key, len(settings), mixed)
    f = f.withColumn("x", labelled(["event", "calm", "coef_prob", "coef_wetness", "bias"], settings)[F.col("i")]).select(*key, "x.*", "total", F.col("n").alias("_nf"))
    bare = w.sparkSession.range(1).select(F.explode(labelled(["event", "calm", "coef_prob", "coef_wetness", "bias"], settings)).alias("x")).select("x.*")
    grid = w.select(*key).distinct().join(F.broadcast(bare))  # a row for each setting
    d = grid.join(f, [*key, *bare.columns], "left").join(o, key, "left").fillna(0, ["total", "_nf", "_no", *[f"o_{m}" for m in experts]])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("official"), ((F.col(f"o_{m}") + F.col("total")) / (F.col("_no") + F.col("_nf"))).alias("mae")) for m in experts]))
    return d.select(*key, *bare.columns, each.alias("y")).select(*key, "y.official", *bare.columns, "y.mae")


# nested neighbourhoods


def nested_gates(queries: DataFrame, pool: DataFrame, by: Sequence[str], features: Sequence[str], experts: Sequence[str], sizes: Sequence[int], temperatures: Sequence[float], shares: Sequence[float]) -> DataFrame:
    """(by, key, neighbours, temperature, share, gate: an array in the order of the experts): the gates of every setting.

    queries and pool have `key` and the features, pool also l_<expert>, the losses. The nearest rows of the pool are
    found once, as many as the largest size takes; running means of their losses serve all smaller sizes (a pool with
    fewer rows is taken whole). A gate is the softmax of the negative losses over the temperature, mixed with that of
    the pool's mean losses by `share`.
    """
    d = _losses(queries, pool, by, features, experts, sizes).withColumn("temperature", F.explode(F.array(*[F.lit(float(x)) for x in temperatures])))
    gate = lambda prefix: _soft_gate(prefix, experts, F.col("temperature"))
    d = d.withColumns({"_l": gate("l"), "_o": gate("o"), "share": F.explode(F.array(*[F.lit(float(x)) for x in shares]))})
    mixed = F.zip_with("_l", "_o", lambda a, b: (1 - F.col("share")) * a + F.col("share") * b)
    return d.select(*by, F.col("query").alias("key"), "neighbours", "temperature", "share", mixed.alias("gate"))


def packed_gates(queries: DataFrame, pool: DataFrame, by: Sequence[str], features: Sequence[str], experts: Sequence[str], sizes: Sequence[int], temperatures: Sequence[float], shares: Sequence[float]) -> DataFrame:
    """(by, key, _g): nested_gates() of a query one after the other, in the order of the settings, which are never rows."""
    d = _losses(queries, pool, by, features, experts, sizes)
    temperatures, shares = sorted(map(float, temperatures)), sorted(map(float, shares))
    d = d.withColumns({f"_{p}{i}": _soft_gate(p, experts, F.lit(x)) for i, x in enumerate(temperatures) for p in "lo"})
    mix = lambda i, s: F.zip_with(f"_l{i}", f"_o{i}", lambda a, b: (1 - s) * a + s * b)
    mixed = [mix(i, s) for i in range(len(temperatures)) for s in shares]
    each = F.struct("neighbours", F.concat(*mixed).alias("g"))
    return d.groupBy(*by, F.col("query").alias("key")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["g"])).alias("_g"))


def _soft_gate(prefix: str, experts: Sequence[str], temperature: Column) -> Column:
    """The softmax of the negative losses <prefix>_<expert> over the temperature."""
    least = F.least(*[f"{prefix}_{m}" for m in experts])
    e = [F.exp((least - F.col(f"{prefix}_{m}")) / temperature) for m in experts]
    return F.array(*[x / sum(e[1:], e[0]) for x in e])


def _losses(queries: DataFrame, pool: DataFrame, by: Sequence[str], features: Sequence[str], experts: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """(by, query, neighbours, l_<expert>, o_<expert>): the mean losses of the nearest rows of each size, and of the pool."""
    near = neighbours(queries, pool, by, features, max(sizes))
    lost = pool.select(*by, F.col("key").alias("neighbour"), *[f"l_{m}" for m in experts])
    w = Window.partitionBy(*by, "query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = near.join(lost.hint("merge"), [*by, "neighbour"]).select(*by, "query", "rank", *[F.avg(f"l_{m}").over(w).alias(f"l_{m}") for m in experts], F.max("rank").over(Window.partitionBy(*by, "query")).alias("_have"))
    size = F.explode(F.array(*[F.lit(int(s)) for s in sizes]))
    run = run.withColumn("neighbours", size).where(F.col("rank") == F.least("neighbours", "_have"))
    overall = pool.groupBy(*by).agg(*[F.avg(f"l_{m}").alias(f"o_{m}") for m in experts])
    return run.join(overall.hint("merge"), list(by))


def teacher_grid(cells: DataFrame, gates: DataFrame | dict[str, DataFrame], by: Sequence[str], groups: Sequence[str], experts: Sequence[str], selected: str, settings: Sequence[tuple], kinds: Sequence[str] = ("neighbours", "temperature", "share")) -> DataFrame:
    """(groups, setting columns, n, baseline_mae, teacher_mae, gain) of mixing the experts by the gates of every setting.

    cells: by, key, groups, y_true and the experts; gates: nested_gates() of all `settings`, whose columns are `kinds`,
    or packed_gates(); or such tables by a name, which is the first of `kinds` then: a sample has gates in all of them.
    A sample's gates of all settings travel as one row with the errors of its cells (of some 64 nodes, where
    cells name them), so neither is repeated; their errors are added up in one pass. gain: baseline less teacher error.
    """
    settings = sorted(settings)
    named = isinstance(gates, dict)
    tables = [gates[k] for k in sorted(gates)] if named else [gates]
    # a row's settings, in their order; each table is packed where it lies
    pack = lambda g: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*kinds[named:], "gate"))), lambda x: x["gate"]))
    packed, *more = [g.withColumnRenamed("_g", f"_g{i}") if "_g" in g.columns else g.groupBy(*by, "key").agg(pack(g).alias(f"_g{i}")) for i, g in enumerate(tables)]
    for g in more:
        packed = packed.join(g.hint("merge"), [*by, "key"])
    packed = packed.select(*by, "key", F.concat(*[f"_g{i}" for i in range(len(tables))]).alias("_g"))
    # the truth may be unknown: NaN keeps its place in the list
    rest = F.array(*[F.coalesce(F.col(m) - F.col("y_true"), F.lit(float("nan"))).cast("double") for m in experts])
    nodes = [F.floor(F.col("node_index") / 64).alias("_nodes")] if "node_index" in cells.columns else []
    own = cells.groupBy(*dict.fromkeys([*by, "key", *groups]), *nodes).agg(F.flatten(F.collect_list(rest)).alias("_r"), F.count("*").alias("_cells"))

    def errors(b: pd.DataFrame) -> Iterator[np.ndarray]:
        count = b["_cells"].to_numpy()
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        rest = np.ascontiguousarray(np.concatenate(b["_r"].to_list()).reshape(-1, len(experts)).T)
        g = np.ascontiguousarray(np.concatenate(b["_g"].to_list()).reshape(len(b), len(settings), len(experts)).transpose(1, 2, 0))
        known = np.isfinite(rest).all() and np.isfinite(g).all()
        yield np.add.reduceat(np.nan_to_num(np.abs(rest[list(experts).index(selected)])), first)
        for k in range(len(settings)):
            mixed = np.repeat(g[k, 0], count) * rest[0]
            for e in range(1, len(experts)):
                mixed += np.repeat(g[k, e], count) * rest[e]
            np.abs(mixed, out=mixed)
            yield np.add.reduceat(mixed if known else np.nan_to_num(mixed), first)

    d = own.join(packed.hint("merge"), [*by, "key"]).select(*groups, "_cells", "_r", "_g")
    s = summed(d, groups, len(settings) + 1, errors, "_cells").withColumn("mae", F.col("total") / F.col("n"))
    base = s.where("i = 0").select(*groups, F.col("mae").alias("baseline_mae"))
    t = s.where("i > 0").withColumn("x", labelled(kinds, settings)[F.col("i") - 1]).join(base, list(groups))
    return t.select(*groups, "x.*", "n", "baseline_mae", F.col("mae").alias("teacher_mae"), (F.col("baseline_mae") - F.col("mae")).alias("gain"))


def ranked_settings(grid: DataFrame, settings: Sequence[str], gains: Sequence[str]) -> DataFrame:
    """(settings, mean gains, rank): means over the seeds' rows, best first by the gains in their order, ties by the settings."""
    g = grid.groupBy(*settings).agg(*[F.avg(x).alias(x) for x in gains])
    order = [F.desc(F.round(x, 9)) for x in gains] + list(settings)
    return g.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a row for each setting
