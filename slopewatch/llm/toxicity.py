"""Toxicity scores by a factorization machine over hashed terms.

The machine adds to a linear model a weight for each pair of terms, the product of two short vectors, so that an
insult counts for more beside the mention of a group than either counts alone. It is trained by Spark's
FMClassifier. Terms are hashed; which of the hashed columns carry a sign of the label is counted over all training
rows first: columns that tell by themselves, and columns of two terms that tell when they stand near each other, even
if neither does alone. Significance alone decides; the number of columns grows with what the rows can prove.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.decontaminate import words_of
from slopewatch.llm.shared import WordHashes, aside, small_or_shuffled, written

#: Columns that terms are hashed to, as a power of two.
BITS = 18
#: Chi-square with the label from which on a column is used (a chance of 0.01), and that of a pair of near terms (1e-6).
SINGLE_CHI, PAIR_CHI = 6.63, 23.93
#: Words that near terms are apart, at most; training rows that a term is in, at least (of a pair: rows of label 1).
NEAR, LEAST_ROWS = 4, 3
#: Size of the filter that pairs pass before they are counted, as a power of two of bits: 8 MB, whatever the corpus. Pairs that
#: pass it by chance are counted in vain and dropped by the join after it.
FILTER_BITS = 26
#: Training rows that the machine is fitted on, at most; the counts for choosing columns cover all training rows.
FIT_ROWS = 60_000
THRESHOLD = 0.3


@dataclass
class Model:
    """Weights of a factorization machine over chosen columns of hashed terms."""

    column: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        """terms: distinct hashed columns of a text."""
        return self.of_places([self.column[t] for t in terms.tolist() if t in self.column])

    def of_places(self, at: list[int]) -> float:
        """The score of a text that has the columns at these places, each once."""
        z = self.bias
        if at:
            v = self.factors[at]
            z += self.linear[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Columns(WordHashes):
    """The column of each word."""

    def __missing__(self, word: bytes) -> int:
        found = super().__missing__(word) & ((1 << BITS) - 1)
        self[word] = found
        return found


class _Places(WordHashes):
    """The place of each word's column in a model, or -1."""

    def __init__(self, column: dict[int, int]) -> None:
        self.column = column

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.column.get(super().__missing__(word) & ((1 << BITS) - 1), -1)
        return found


def terms_of(text: str | None, columns: _Columns) -> np.ndarray:
    """Distinct columns of a whole text's words (runs of letters and digits, A-Z lower-cased)."""
    if not text:
        return np.zeros(0, np.int64)
    words = set(words_of(text))
    return np.unique(np.fromiter(map(columns.__getitem__, words), np.int64, len(words)))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def near_pairs(text: str | None, columns: _Columns) -> np.ndarray:
    """Distinct pairs of different columns whose words stand at most NEAR words apart, lesser column first, as one number each."""
    c = np.fromiter(map(columns.__getitem__, words_of(text or "")), np.int64)
    found = [np.zeros(0, np.int64)]
    for gap in range(1, min(NEAR, len(c) - 1) + 1):
        a, b = np.minimum(c[gap:], c[:-gap]), np.maximum(c[gap:], c[:-gap])
        found.append((a << BITS | b)[a != b])
    return np.unique(np.concatenate(found))


def _bit(pairs: np.ndarray, bits: int) -> np.ndarray:
    """The bit that a pair sets in a filter of 1 << bits."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _pair_filter(pairs: DataFrame) -> np.ndarray:
    """The filter of (term), in bytes: its words of 32 bits are made on the executors, at most 1 << (FILTER_BITS - 5) rows."""

    bits = FILTER_BITS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = _bit(b.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(np.left_shift(1, bit & 31))], names=["word", "mask"])

    words = pairs.mapInArrow(task, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << bits - 5, np.uint32)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    return out


def _lists(df: DataFrame, of, wanted=None) -> DataFrame:
    """(doc_id, label, terms) of rows (doc_id, text, label); of: what makes the numbers of a text; wanted: broadcast filter of the pairs that stay."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _Columns()
        for b in batches:
            terms = [of(x.as_py(), columns) for x in b.column(1)]
            if wanted is not None:
                bits = len(wanted.value).bit_length() + 4
                terms = [t[wanted.value[(bit := _bit(t, bits)) >> 5] >> (bit & 31).astype(np.uint32) & 1 == 1] for t in terms]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(terms, pa.list_(pa.int64()))], names=["doc_id", "label", "terms"])

    return df.mapInArrow(task, "doc_id long, label int, terms array<bigint>")


def _telling(counts: DataFrame, n: int, positive: int, least: float) -> DataFrame:
    """Of (term, n, p): terms whose presence has a chi-square of at least `least` with the label, for or against it."""
    expected = F.col("n") * (positive / n)
    spread = F.col("n") * (positive / n) * (1 - positive / n) * (n - F.col("n") + 1) / n
    return counts.where(F.col("n") >= LEAST_ROWS).where((F.col("p") - expected) ** 2 / spread >= least).select("term")


def telling_pairs(train: DataFrame, n: int, positive: int) -> DataFrame:
    """(term) of the columns of near pairs that tell the label; pairs are looked for in rows of label 1 and counted in all."""
    counted = lambda d: d.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    seen = written(counted(_lists(train.where("label = 1"), near_pairs)).where(F.col("n") >= LEAST_ROWS).select("term"), "toxic-pairs")
    wanted = train.sparkSession.sparkContext.broadcast(_pair_filter(seen))
    counts = counted(_lists(train, near_pairs, wanted)).join(seen, "term", "left_semi")
    pair = F.col("term")
    return _telling(counts, n, positive, PAIR_CHI).select(F.explode(F.array(F.shiftright(pair, BITS), pair.bitwiseAND(F.lit((1 << BITS) - 1)))).alias("term"))


def fit(docs: DataFrame, labels: DataFrame, factors: int = 4, iterations: int = 150, fit_rows: int = FIT_ROWS) -> Model:
    """Learns labels.toxic from the labelled rows that aren't held out.

    Rows with a null id, label or text teach nothing. With no labelled rows, or labels of one kind only, the model is
    the smoothed share of label 1.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = small_or_shuffled(written(known.where(~held_out(F.col("doc_id"))), "toxic-labels"))
    train = docs.select("doc_id", "text").where("text is not null").join(known, "doc_id").select("doc_id", "text", "label")
    rows = written(_lists(train, terms_of), "toxic-terms")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    base = (positive + 0.5) / (n + 1)
    if not 0 < positive < n:
        return Model({}, float(np.log(base / (1 - base))), np.zeros(0), np.zeros((0, factors)))
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    best = _telling(counts, n, positive, SINGLE_CHI).union(telling_pairs(train, n, positive)).distinct().orderBy("term").collect()  # below 1 << BITS numbers
    if not best:
        return Model({}, float(np.log(base / (1 - base))), np.zeros(0), np.zeros((0, factors)))
    column = {r["term"]: i for i, r in enumerate(best)}

    # a bounded sample, by hash of the id; everything else covers all rows
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / n))

    words = CountVectorizerModel.from_vocabulary([str(t) for t in column], inputCol="words", outputCol="features").setBinary(True)
    data = words.transform(rows.where(part).select(F.col("label").cast("double").alias("label"), F.col("terms").cast("array<string>").alias("words")))
    data = data.select("label", "features").repartition(8).cache()
    fm = FMClassifier(factorSize=factors, maxIter=iterations, stepSize=0.1, regParam=1e-4, initStd=0.05, solver="adamW", seed=7, tol=1e-5).fit(data)
    data.unpersist()
    return Model(column, float(fm.intercept), fm.linear.toArray(), fm.factors.toArray())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and `_score` from 0 to 1. Null and empty texts get the model's score of no terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        places = _Places(m.column)
        for b in batches:
            texts = (x.as_py() for x in b.column(b.schema.names.index("text")))
            scores = [m.of_places(sorted({*map(places.__getitem__, set(words_of(t or "")))} - {-1})) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(task, schema + ", _score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is below the threshold. Columns stay."""
    held, own = aside(docs, ["_score"])
    return score(held, fit(docs, labels)).where(F.col("_score") < threshold).select(*own)


def crc_remainder(doc_id: int) -> int:
    """The same remainder as held_out() uses, in Python."""
    return zlib.crc32(str(doc_id).encode()) % 4
