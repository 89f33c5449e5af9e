"""Screens of lagged rain features against responses of motion: rank correlations, drawn permutations, contrasts.

All features and all permutations of a response at a lag come out of one product of integer matrices: the permuted
ranks of the response times the ranks of the features. Comparisons of permuted with observed correlations are of whole
numbers and thus exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.functions.common import drawn

#: Orders that are held at once, in numbers.
BLOCK = 4_000_000
RESPONSES = ("abs_increment", "signed_increment", "abs_increment_change")


def motion_responses(panel: DataFrame, scopes: DataFrame) -> DataFrame:
    """(site_id, scope, response, t, y): the mean absolute and mean signed increment of a scope's nodes, and the change of the former.

    panel: site_id, node_index, t, disp; scopes: site_id, node_index, scope. The first acquisition has no increment;
    the first change is 0. Scopes without nodes have no rows.
    """
    w = Window.partitionBy("site_id", "node_index").orderBy("t")
    step = panel.select("site_id", "node_index", "t", (F.col("disp") - F.lag("disp").over(w)).alias("_d")).where("_d is not null")
    mean = step.join(scopes, ["site_id", "node_index"]).groupBy("site_id", "scope", "t").agg(F.avg(F.abs("_d")).alias("a"), F.avg("_d").alias("s"))
    along = Window.partitionBy("site_id", "scope").orderBy("t")  # a row for each acquisition
    kinds = [F.col("a"), F.col("s"), F.coalesce(F.col("a") - F.lag("a").over(along), F.lit(0.0))]
    d = mean.select("site_id", "scope", "t", *[c.alias(f"_{k}") for k, c in enumerate(kinds)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("response"), F.col(f"_{k}").alias("y")) for k, n in enumerate(RESPONSES)]))
    return d.select("site_id", "scope", "t", each.alias("x")).select("site_id", "scope", "x.response", "t", "x.y")


def centred_ranks(x: np.ndarray) -> np.ndarray:
    """Twice the average ranks of each column, less their mean: whole numbers, as ties share a half at most."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    v = np.take_along_axis(x, order, 0)
    place = np.arange(n)[:, None]
    new = np.ones((n + 1, x.shape[1]), bool)  # where a value begins
    new[1:n] = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
    first = np.maximum.accumulate(np.where(new[:n], place, 0), axis=0)
    last = np.minimum.accumulate(np.where(new[1:], place, n)[::-1], axis=0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, first + last + 1.0 - n, 0)
    return out


@lru_cache(maxsize=16)
def drawn_orders(n: int, permutations: range, seed: int) -> np.ndarray:
    """The same for all responses of n rows, and at most BLOCK numbers: for each permutation the items 0 to n - 1 by their drawn number, then by themselves."""
    item = np.arange(1, n + 1, dtype=np.int64)
    return np.argsort(drawn(np.array(permutations, np.int64)[:, None], item[None, :], seed, 65521), axis=1, kind="stable")


def rank_screen(x: np.ndarray, y: np.ndarray, permutations: int, seed: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spearman's rho of y with each column of x and (#{|permuted| >= |rho|} + 1) / (permutations + 1); NaN where either is constant. ranks: centred_ranks(x), if known."""
    rho, p = rank_screens(x, y[:, None], permutations, seed, ranks)
    return rho[0], p[0]


def rank_screens(x: np.ndarray, y: np.ndarray, permutations: int, seed: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """rank_screen() of each column of y, which all take the same orders: a row for each."""
    a, b = centred_ranks(x) if ranks is None else ranks, np.ascontiguousarray(centred_ranks(y).T)
    own, reached = b @ a, np.zeros((y.shape[1], x.shape[1]), np.int64)
    step = max(1, BLOCK // max(y.size, 1))
    for first in range(1, permutations + 1, step):
        orders = drawn_orders(len(y), range(first, min(first + step, permutations + 1)), seed)
        reached += (np.abs(b[:, orders] @ a) >= np.abs(own)[:, None, :]).sum(1)
    size = np.sqrt((a**2).sum(0) * (b**2).sum(1)[:, None])
    known = (size > 0) & (x.std(0) >= 1e-9) & (y.std(0) >= 1e-9)[:, None]
    return np.where(known, own / np.where(size > 0, size, 1), np.nan), np.where(known, (reached + 1) / (permutations + 1), np.nan)


def contrasts(x: np.ndarray, y: np.ndarray, high: float = 0.9, low: float = 0.5, parts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The means of y where each column of x is at least its high quantile, and where it is at most its low one; a row for each
    column of y if it has columns. parts: high_low(x), if known."""
    above, below = high_low(x, high, low) if parts is None else parts
    return tuple(y.T @ k.astype(float) / k.sum(0) for k in (above, below))


def high_low(x: np.ndarray, high: float = 0.9, low: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Where each column of x is at least its high quantile, and where it is at most its low one."""
    q = np.quantile(x, (high, low), axis=0)
    return x >= q[0], x <= q[1]


def lag_screen(features: DataFrame, names: Sequence[str], responses: DataFrame, lags: Sequence[int] = range(7), permutations: int = 100, seed: int = 7, least: int = 8) -> DataFrame:
    """Every feature at every lag against every response of a site's scopes.

    features: site_id, t and the columns of `names`, null counting as 0; responses: site_id, scope, response, t, y. A
    feature at t - lag meets the response at t; combinations of fewer than `least` rows are left out, null responses
    too. Returns site_id, scope, response, lag, feature, n, rho, p, high, low, delta, lift; rho and p are null where
    either side is constant, lift where the low mean isn't above 1e-9. A site's two tables have a row for each
    acquisition (and scope), not for each node, and meet in one task.
    """
    names, lags, kept = list(names), [int(k) for k in lags], ["rho", "p", "high", "low"]
    kind = dict(responses.dtypes)["site_id"]

    def task(key, f: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        times = f["t"].to_numpy()
        order = np.argsort(times, kind="stable")
        times, values = times[order], f[names].fillna(0.0).to_numpy(float)[order]
        r = r.dropna(subset=["scope", "response", "y"])
        (scope, scopes), (response, kinds) = pd.factorize(r["scope"]), pd.factorize(r["response"])
        group, at, y = scope * len(kinds) + response, r["t"].to_numpy(), r["y"].to_numpy(float)
        order = np.lexsort((at, group))
        group, at, y = group[order], at[order], y[order]
        alike = {}  # the responses mostly share their times, and so the ranks of the features
        for part in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1) if len(group) else []:
            alike.setdefault(at[part].tobytes(), []).append(part)
        out = []
        for parts in alike.values():
            t, z, which = at[parts[0]], np.stack([y[p] for p in parts], axis=1), group[[p[0] for p in parts]]
            for lag in lags if len(times) else []:
                where = np.minimum(np.searchsorted(times, t - lag), len(times) - 1)
                met = times[where] == t - lag
                if met.sum() < least:
                    continue
                x = values[where[met]]
                found = [*rank_screens(x, z[met], permutations, seed), *contrasts(x, z[met])]
                out.append((which, np.full(len(which), lag), np.full(len(which), met.sum()), np.stack(found)))
        if not out:
            return pd.DataFrame(columns=["site_id", "scope", "response", "lag", "n", *kept])
        which, lag, n = (np.concatenate([o[k] for o in out]) for k in range(3))
        labels = {"site_id": key[0], "scope": np.asarray(scopes, object)[which // len(kinds)], "response": np.asarray(kinds, object)[which % len(kinds)], "lag": lag, "n": n}
        numbers = np.concatenate([o[3] for o in out], axis=1)
        return pd.DataFrame(labels | {k: list(x) for k, x in zip(kept, numbers, strict=True)})

    known = responses.select(F.col("site_id").alias("_site"), "scope", "response", "t", F.col("y").cast("double").alias("y"))
    table = features.select("site_id", "t", *[F.col(n).cast("double").alias(n) for n in names])
    # the features of a combination travel in one row
    schema = f"site_id {kind}, scope string, response string, lag int, n long, " + ", ".join(f"{k} array<double>" for k in kept)
    d = table.groupBy("site_id").cogroup(known.groupBy("_site")).applyInPandas(task, schema)
    d = d.select("site_id", "scope", "response", "lag", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), *kept)).alias("x"))
    d = d.select("site_id", "scope", "response", "lag", "x.feature", "n", *[F.col(f"x.{k}").alias(k) for k in kept])
    d = d.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("rho", "p", "high", "low")})
    return d.withColumn("delta", F.col("high") - F.col("low")).withColumn("lift", F.when(F.col("low") > 1e-9, F.col("high") / F.col("low")))


def density_screen(features: DataFrame, names: Sequence[str], density: DataFrame, permutations: int = 1000, seed: int = 7) -> DataFrame:
    """(site_id, feature, n, rho, p): rain features against the density of regional change points (site_id, t, density) at the same time."""
    r = density.select("site_id", F.lit("regions").alias("scope"), F.lit("cpd_density").alias("response"), "t", F.col("density").alias("y"))
    return lag_screen(features, names, r, [0], permutations, seed, least=3).select("site_id", "feature", "n", "rho", "p")
