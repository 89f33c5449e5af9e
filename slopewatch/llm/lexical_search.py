"""Ranked lexical search as exact inner-product search in ball trees of sparse documents.

A document is a vector of the saturated frequencies of its terms, a query one of its terms' weights; the score is
their inner product, in integers. Documents are dealt into blocks, and each block becomes a tree of balls (a centroid
and radii). No document of a ball scores more than the query's product with the centroid plus its length times the
radius, nor, as weights aren't negative, more than its product with the centroid plus the radius for each term. By
the lesser of both, subtrees are opened best first until no ball can hold a better document than those found, and the
documents of a leaf are scored exactly. In sparse texts of many terms the radius of the whole ball is much longer than
any query's share of it, and it's the radii for each term that close balls.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.llm.decontaminate import BROADCAST_BYTES, parts_of, words_of
from slopewatch.llm.shared import written

TOP = 20
#: A document's length counts for 25 of 100 parts of the saturation, which is 12 / 1000 of it.
LENGTH_SHARE, SATURATION, UNIT = 25, 12, 1000
#: Documents and terms of documents in a block, at most (one document more is taken whole); documents in a leaf, at least.
BLOCK_DOCS, BLOCK_TERMS, LEAF = 8192, 1_500_000, 32
#: Numbers in the centroids of a block, about, and in the radii; leaves grow where the vocabulary is large.
CENTROID_NUMBERS = 4_000_000
#: Documents whose scores give every query a score to beat before the search, about (chosen by a hash of the id).
SEED_DOCS = 20_000


@dataclass
class Queries:
    """Queries as sparse vectors of whole numbers over the terms of all of them."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    #: The score that a document must reach, at least 1.
    least: np.ndarray

    @classmethod
    def of(cls, counts: list[Counter], weight: dict[int, int]) -> Queries:
        held = [sorted((t, c * weight[t]) for t, c in q.items() if weight.get(t, 0) > 0) for q in counts]
        return cls([np.array([t for t, _ in q], np.int64) for q in held], [np.array([w for _, w in q], np.int64) for q in held], np.ones(len(held), np.int64))


@dataclass
class Rows:
    """Sparse rows one after the other: row i has the terms and values from start[i] to start[i + 1]; none is empty."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def sums(self, dense: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
        """The inner product of each row from low to high with a dense vector."""
        high = len(self.start) - 1 if high is None else high
        a, b = self.start[low], self.start[high]
        return np.add.reduceat(self.value[a:b] * dense[self.term[a:b]], self.start[low:high] - a)

    def take(self, order: np.ndarray) -> Rows:
        size = np.diff(self.start)[order]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[order] - start[:-1], size) + np.arange(start[-1])
        return Rows(start, self.term[at], self.value[at])


class BallTree:
    """A balanced tree over rows: node k has the children 2k + 1 and 2k + 2, the leaves are those of the last level."""

    def __init__(self, rows: Rows, width: int) -> None:
        n = len(rows.start) - 1
        leaf = max(LEAF, -(-2 * n * width // CENTROID_NUMBERS))
        self.depth = max(0, math.ceil(math.log2(n / leaf)))
        nodes = (2 << self.depth) - 1
        self.centroid, self.radius, self.above = np.zeros((nodes, width)), np.zeros(nodes), np.zeros((nodes, width))
        self.low, self.high = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.high[0] = n
        order = np.arange(n)
        for node in range(nodes):
            a, b = self.low[node], self.high[node]
            part = rows.take(order[a:b])
            real = Rows(part.start, part.term, part.value.astype(float))
            center = np.bincount(part.term, weights=part.value, minlength=width) / max(1, b - a)
            square = np.add.reduceat(real.value**2, part.start[:-1])
            middle = center @ center
            far = square - 2 * real.sums(center) + middle
            # rounding can't make the radius too small: what was subtracted counts with 1e-9 of its size
            self.centroid[node] = center
            self.radius[node] = math.sqrt(max(0.0, float(far.max())) + 1e-9 * float(square.max() + middle)) * (1 + 1e-9)
            np.maximum.at(self.above[node], part.term, real.value)
            self.above[node] -= center
            if 2 * node + 2 < nodes:
                one = int(far.argmax())
                pole = np.zeros(width)
                pole[part.term[part.start[one] : part.start[one + 1]]] = real.value[part.start[one] : part.start[one + 1]]
                apart = square - 2 * real.sums(pole)
                other = int(apart.argmax())
                pole[part.term[part.start[other] : part.start[other + 1]]] -= real.value[part.start[other] : part.start[other + 1]]
                order[a:b] = order[a:b][np.argsort(real.sums(pole), kind="stable")]
                half = (a + b) // 2
                self.low[2 * node + 1], self.high[2 * node + 1] = a, half
                self.low[2 * node + 2], self.high[2 * node + 2] = half, b
        self.order, self.rows, self.leaves = order, rows.take(order), nodes // 2

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node, a number that no score of its rows exceeds."""
        w = weights.astype(float)
        center = self.centroid[:, terms] @ w
        return (center + np.minimum(math.sqrt(float(w @ w)) * self.radius, self.above[:, terms] @ w)) * (1 + 1e-9) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: Best) -> int:
        """Adds to `best` all rows that belong to it; returns the number of rows scored. dense: the query, zeros elsewhere."""
        bound = self.bounds(terms, weights)
        open_, scored = [(-bound[0], 0)], 0
        while open_ and -open_[0][0] >= best.least:
            node = heapq.heappop(open_)[1]
            if node >= self.leaves:
                low, high = int(self.low[node]), int(self.high[node])
                best.add(self.rows.sums(dense, low, high), self.order[low:high])
                scored += high - low
                continue
            for child in (2 * node + 1, 2 * node + 2):
                if bound[child] >= best.least:
                    heapq.heappush(open_, (-min(bound[child], bound[node]), child))
        return scored


class Best:
    """The highest scores of a query so far, with ids; equal scores by ascending id, null ids last."""

    def __init__(self, top: int, least: int) -> None:
        self.top, self.least = top, max(1, int(least))
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = self.nulls = None  # of the block that is searched

    def add(self, scores: np.ndarray, at: np.ndarray) -> None:
        fits = scores >= self.least
        if fits.any():
            at = at[fits]
            score, ids, null = np.concatenate([self.score, scores[fits]]), np.concatenate([self.id, self.ids[at]]), np.concatenate([self.null, self.nulls[at]])
            kept = np.lexsort((ids, null, -score))[: self.top]
            self.score, self.id, self.null = score[kept], ids[kept], null[kept]
            if len(kept) == self.top:
                self.least = max(self.least, int(self.score[-1]))  # an equal score may still have a lesser id


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """The saturated frequencies of terms in documents of n words."""
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // words
    return 1_000_000_000 * tf // (UNIT * tf + SATURATION * m)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Rows]]:
    """(ids, which are null, words, terms with frequencies) of a bounded number of documents each."""
    held, docs, terms = [], 0, 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("doc_id")
        term, tf = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
        size = term.value_lengths().to_numpy(zero_copy_only=False)
        start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), table.column("n").to_numpy(), Rows(start, term.flatten().to_numpy(), tf.flatten().to_numpy())

    for batch in batches:
        at = 0
        sizes = batch.column(batch.schema.names.index("terms")).value_lengths().to_numpy(zero_copy_only=False)
        for i, size in enumerate(sizes.tolist()):
            docs, terms = docs + 1, terms + size
            if docs >= BLOCK_DOCS or terms >= BLOCK_TERMS:
                held.append(batch.slice(at, i + 1 - at))
                yield block()
                held, docs, terms, at = [], 0, 0, i + 1
        if at < len(sizes):
            held.append(batch.slice(at))
    if held:
        yield block()


def _search(vectors: DataFrame, queries: Queries, docs: int, words: int, top: int) -> DataFrame:
    """(query, doc_id, score): of each task, the best documents for each query."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = [Best(top, x) for x in q.least]
        for ids, nulls, n, rows in _blocks(batches):
            used, term = np.unique(rows.term, return_inverse=True)
            rows = Rows(rows.start, term, impacts(rows.value.astype(np.int64), np.repeat(n, np.diff(rows.start)), docs, words))
            tree, dense = BallTree(rows, len(used)), np.zeros(len(used), np.int64)
            for b, terms, weights in zip(best, q.terms, q.weights, strict=True):
                at = np.searchsorted(used, terms)
                here = at < len(used)
                here[here] = used[at[here]] == terms[here]
                if here.any():
                    b.ids, b.nulls = ids, nulls
                    dense[at[here]] = weights[here]
                    tree.search(at[here], weights[here], dense, b)
                    dense[at[here]] = 0
                    b.ids = b.nulls = None
        for k, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), k, np.int32)), pa.array(b.id, mask=b.null), pa.array(b.score)], names=["query", "doc_id", "score"])

    return vectors.mapInArrow(task, "query int, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of (query, doc_id, score) with their rank. Spark keeps `top` rows of a query in each task before the exchange."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def sparse_documents(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term: the number of their terms, and frequencies of the vocabulary's."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            texts = b.column(1)
            kept, n, terms, tfs = [], [], [], []
            for i in range(b.num_rows):
                words = words_of(texts[i].as_py() or "")
                if words:
                    term, tf = np.unique(np.array([x for x in map(number, words) if x is not None], np.int32), return_counts=True)
                    kept.append(i)
                    n.append(len(words))
                    terms.append(term)
                    tfs.append(tf)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n long, terms array<int>, tfs array<bigint>")


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _search_part(docs: DataFrame, items: list[tuple[int | None, str]], top: int, seed_docs: int) -> DataFrame:
    """The ranked documents of some items."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    counts = [Counter(vocabulary.setdefault(x, len(vocabulary)) for x in words_of(text)) for _, text in items]
    vectors = written(sparse_documents(docs, vocabulary), "sparse-documents")
    n_docs, n_words = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each of the items' terms
    queries = Queries.of(counts, {r["term"]: term_weight(n_docs, r["count"]) for r in df})
    vectors = vectors.where(F.size("terms") > 0)
    # the last of the best scores among some documents is a score that the best of all documents reach, too
    if n_docs > 4 * seed_docs > 0:
        some = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * seed_docs / n_docs)
        for r in _ranked(_search(vectors.where(some), queries, n_docs, n_words, top), top).where(F.col("rank") == top).collect():  # a row for each query
            queries.least[r["query"]] = r["score"]
    ranked = _ranked(_search(vectors, queries, n_docs, n_words, top), top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "query int, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, limit: int = BROADCAST_BYTES, seed_docs: int = SEED_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) the `top` documents with the highest scores above 0.

    Ids are integers. Null and empty texts, and texts without terms, are no documents: they count for no statistic and
    are never found; items without terms find nothing. Each row of documents is ranked by itself, so repeated rows
    take a rank each; equal scores go by ascending id, null ids last. Rows of items with equal ids are ranked each by
    itself. Statistics cover all documents. Items above `limit` bytes are searched for in parts, one after the other.
    """
    found = [_search_part(docs, part, top, seed_docs) for part in parts_of(items, limit)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
