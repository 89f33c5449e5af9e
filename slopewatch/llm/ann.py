"""Approximate nearest neighbours by learned partitions.

A sample's neighbour graph is cut into balanced partitions (few neighbours are separated), and a small classifier
learns to name a vector's partition. All vectors are indexed in their most probable partition; a query is routed to
several most probable ones and reranked there by exact inner products in double precision. The number of partitions
grows with the root of the table's size. Partitions lie in a fixed number of groups, and a query goes once to each
group that has some of its partitions, with their list; there it meets the vectors of these partitions only. So what
queries return stays in proportion to the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.llm.shared import small_or_shuffled, written

#: Vectors that partitions are learned from, at most: those with the least hashes. Everything is indexed.
SAMPLE = 8_192
#: Neighbours in the sample's graph, and sample vectors for each partition, at least.
NEIGHBOURS, PER_PARTITION = 20, 32
#: Groups that partitions are dealt to.
GROUPS = 20
#: Share of the sample's neighbours that its vectors must find; as many partitions are visited as that takes.
RECALL = 0.93
#: Vectors and queries that meet in one task at a time.
CELL_VECTORS, CELL_QUERIES = 20_000, 2_000


def valid(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector isn't null or zero and holds finite numbers only, of the length that most of these have (of equally many, the least)."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.where(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
    usual = good.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size(v) == usual["n"]) if usual else good


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column]).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The k nearest others of each row, by inner product."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + block] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 11, rounds: int = 12) -> np.ndarray:
    """A label for each row: neighbours agree where they can, and no partition is more than a tenth above the mean.

    Starts from balanced nearest seeds; then rows move to the partition of most of their neighbours, if it has room.
    """
    rng = np.random.default_rng(seed)
    n, room = len(x), int(np.ceil(1.1 * len(x) / parts))
    centre = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)
    for _ in range(8):
        score = x @ centre.T
        choice = np.argsort(-score, axis=1, kind="stable")
        fill, open_rows = np.zeros(parts, np.int64), np.arange(n)
        for j in range(parts):  # each partition takes the nearest of those that have it as their next choice, while it has room
            wanted = choice[open_rows, j]
            order = np.lexsort((-score[open_rows, wanted], wanted))
            first = np.searchsorted(wanted[order], wanted[order])
            taken = order[np.arange(len(order)) - first < (room - fill)[wanted[order]]]
            label[open_rows[taken]] = wanted[taken]
            fill += np.bincount(wanted[taken], minlength=parts)
            open_rows = np.delete(open_rows, taken)
            if not len(open_rows):
                break
        for p in range(parts):
            if (label == p).any():
                c = x[label == p].mean(axis=0)
                centre[p] = c / max(np.linalg.norm(c), 1e-12) * np.median(np.linalg.norm(x, axis=1))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    fill = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (both[0], label[both[1]]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain).tolist():
            if gain[i] <= 0:
                break
            p = int(votes[i].argmax())
            if fill[p] < room:
                fill[label[i]] -= 1
                fill[p] += 1
                label[i] = p
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A multinomial logistic model of a vector's partition."""

    weight: np.ndarray
    bias: np.ndarray
    #: Partitions that a query visits.
    probes: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, parts: int, steps: int = 300, rate: float = 0.05) -> Router:
        scale = 1 / max(np.sqrt((x**2).sum(1).mean()), 1e-12)
        x = x * scale
        w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        rng = np.random.default_rng(5)
        for t in range(1, steps + 1):  # Adam on random batches
            at = rng.integers(0, len(x), min(1024, len(x)))
            z = x[at] @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), label[at]] -= 1
            g, gb = x[at].T @ p / len(at) + 1e-5 * w, p.mean(0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= step * m / (np.sqrt(v) + 1e-8)
            b -= step * mb / (np.sqrt(vb) + 1e-8)
        return cls(w * scale, b)

    def best(self, x: np.ndarray, k: int) -> np.ndarray:
        z = x @ self.weight + self.bias
        return np.argsort(-z, axis=1, kind="stable")[:, :k]


def learn(vectors: DataFrame, sample: int = SAMPLE) -> Router:
    """vectors: (id, v), valid. The sample is the vectors with the least hashes, equal ones once; the same in every run."""
    n = vectors.count()
    rows = vectors.select("v").distinct().orderBy(F.xxhash64("v")).limit(sample).collect()
    x = matrix([r[0] for r in rows])
    x = x[np.lexsort(x.T)] if len(x) else x
    parts = int(min(n**0.5, len(x) / PER_PARTITION))
    if parts < 2:
        return Router(np.zeros((x.shape[1] if len(x) else 1, 1)), np.zeros(1))
    graph = neighbour_graph(x, NEIGHBOURS)
    router = Router.fit(x, balanced_partitions(x, graph, parts), parts)
    # at which place of a vector's order the partitions of its neighbours stand
    order = router.best(x, parts)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, order[graph, 0], axis=1).ravel())
    router.probes = int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1
    return router


def routed(df: DataFrame, router, k: int) -> DataFrame:
    """(id, v, part, parts): a row for each group that holds some of the k most probable partitions, with their list."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                s = b.slice(a, 2000)
                best = router.value.best(matrix(s.column(1).to_pylist()), k)
                key = np.repeat(np.arange(len(best)), best.shape[1]) * GROUPS + best.ravel() % GROUPS
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(best.ravel()[order].astype(np.int32)))
                cols = [c.take(pa.array(key[order][starts] // GROUPS)) for c in s.columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array((key[order][starts] % GROUPS).astype(np.int32)), lists], names=["id", "v", "part", "parts"])

    return df.mapInArrow(task, "id long, v array<double>, part int, parts array<int>")


def nearest_in_cell(key, queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query of one cell, among those in its partitions, best first, ties to the smaller id."""
    if queries.empty or rows.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    rows = rows.assign(part=[p[0] for p in rows["parts"]]).sort_values(["part", "id"], kind="stable")
    ids, x, part = rows["id"].to_numpy(), matrix(rows["v"]), rows["part"].to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    out = []
    for a in range(0, len(queries), 256):
        q = queries.iloc[a : a + 256]
        y, own, wanted = matrix(q["v"]), q["id"].to_numpy(), [set(p) for p in q["parts"]]
        s = np.full((len(q), len(ids)), -np.inf)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            at = np.array([i for i, p in enumerate(wanted) if part[lo] in p], np.int64)
            if len(at):
                s[at, lo:hi] = y[at] @ x[lo:hi].T
        s[own[:, None] == ids[None, :]] = -np.inf
        # a little more than k, so that ties at the end can be told apart; scores are summed anew, the same way everywhere
        n = min(k, len(ids))
        floor = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        for i in range(len(q)):
            least = floor[i] - 1e-9 * (1 + abs(floor[i])) if np.isfinite(floor[i]) else floor[i]
            at = np.flatnonzero((s[i] >= least) & (s[i] > -np.inf))
            exact = (x[at] * y[i]).sum(axis=1)
            best = np.lexsort((ids[at], -exact))[:k]
            out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[at][best], "score": exact[best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, is_query, k: int = 20, probe_share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, never itself.

    vectors: vec_id and embedding. Vectors that are null, zero or hold null or non-finite components take no part,
    nor do those of another length than most, nor rows with a null id. A repeated row is one vector if id and components
    agree; an id with several vectors is as near as its nearest. With fewer candidates than k all that the query's
    partitions hold are returned. Groups with many vectors, such as thousands of copies, are dealt by id into cells of
    bounded size, and queries likewise: a query meets all cells of its groups. Without a probe_share, queries visit as
    many partitions as the sample's own neighbours need.
    """
    v = valid(vectors.where("vec_id is not null").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), "v")
    v = v.dropDuplicates(["id", "v"])
    router = learn(v)
    parts = len(router.bias)
    probes = router.probes if probe_share is None else max(1, int(np.ceil(probe_share * parts)))
    shared = vectors.sparkSession.sparkContext.broadcast(router)
    index = written(routed(v, shared, 1), "ann-index")
    queries = written(routed(v.where(is_query(F.col("id"))), shared, probes), "ann-queries")
    sizes = index.groupBy("part").agg(F.count("*").alias("n")).join(queries.groupBy("part").agg(F.count("*").alias("m")), "part")
    sizes = small_or_shuffled(written(sizes.select("part", F.ceil(F.col("n") / CELL_VECTORS).cast("int").alias("a"), F.ceil(F.col("m") / CELL_QUERIES).cast("int").alias("b")), "ann-sizes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, "part").select("part", F.pmod(F.xxhash64("id"), "b").cast("int").alias("y"), every("a").alias("x"), "id", "v", "parts")
    right = index.join(sizes, "part").select("part", F.pmod(F.xxhash64("id"), "a").cast("int").alias("x"), every("b").alias("y"), "id", "v", "parts")
    keys = ["part", "x", "y"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda key, q, r: nearest_in_cell(key, q, r, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # met in two partitions
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
