"""Sharding by histogram sort: splitters of near-equal bytes are found by counting, then rows are exchanged once.

Rows are ordered by a key that keeps equal texts together and spreads a group of equal texts by doc_id, so that
even a group larger than a shard can be divided. Each round counts, in all partitions, the exact bytes and rows
below some probes between the known bounds of every splitter; probes close in until the bytes below each splitter
are within the tolerance, or no key lies between its bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.llm.shared import aside, written

SHARDS = 24
#: Bytes of a sorting bucket, of which a shard has several; at most MOST_BUCKETS in all.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 24_000
#: Share of a bucket by which a splitter may miss its target, and probes between the bounds of each splitter.
TOLERANCE, PROBES = 0.0005, 15


def row_size() -> Column:
    """UTF-8 bytes of the text (null: none) and 8 for the id."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")


def sort_key() -> Column:
    """40 bits of the text's hash, then 24 of the id's."""
    low = (1 << 24) - 1
    return F.xxhash64("text").bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(low)))


def counts_below(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of keys below each of the sorted probes."""
    shared = keys.sparkSession.sparkContext.broadcast(probes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        sizes, rows = np.zeros(len(p) + 1, np.int64), np.zeros(len(p) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(p, b.column(0).to_numpy(), side="right")
            sizes += np.bincount(at, b.column(1).to_numpy().astype(np.float64), len(p) + 1).astype(np.int64)
            rows += np.bincount(at, minlength=len(p) + 1)
        hit = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(sizes[hit]), pa.array(rows[hit])], names=["at", "size", "n"])

    found = keys.mapInArrow(task, "at int, size long, n long").groupBy("at").agg(F.sum("size"), F.sum("n")).collect()
    size, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for at, s, k in found:
        size[at], n[at] = s, k
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


@dataclass
class Splitters:
    """Bucket b holds keys from keys[b - 1] up to, but without, keys[b]; `rows` come before keys[b] in all."""

    keys: np.ndarray
    rows: np.ndarray
    per_shard: int


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> Splitters:
    """keys: (key, size). One pass over it for each round; what comes to the driver is bounded by the number of probes."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_shard = int(max(1, min(MOST_BUCKETS // shards, -(-total // (BUCKET_BYTES * shards)))))
    buckets = shards * per_shard
    target = [total * k // buckets for k in range(1, buckets)]
    allowed = tolerance * total / buckets
    # every splitter is between low (too few bytes below, or none known) and high (too many)
    low, high = [-(1 << 63)] * len(target), [(1 << 63) - 1] * len(target)
    best: list[tuple[int, int, int]] = [(1 << 62, -(1 << 63), 0)] * len(target)  # (miss, key, rows)
    while True:
        probes = set()
        for k, (a, b) in enumerate(zip(low, high, strict=True)):
            if best[k][0] > allowed and b - a > 1:
                step = max(1, (b - a) // (PROBES + 1))
                probes |= {a + step * (i + 1) for i in range(PROBES) if a < a + step * (i + 1) < b} | ({a, b} if best[k][0] == 1 << 62 else set())
        if not probes:
            break
        p = np.array(sorted(probes), np.int64)
        size, rows = counts_below(keys, p)
        for k, t in enumerate(target):
            if best[k][0] <= allowed:
                continue
            i = int(np.searchsorted(size, t, side="left"))
            for j in (i - 1, i):
                if 0 <= j < len(p):
                    best[k] = min(best[k], (abs(int(size[j]) - t), int(p[j]), int(rows[j])))
            if i > 0:
                low[k] = max(low[k], int(p[i - 1]))
            if i < len(p):
                high[k] = min(high[k], int(p[i]))
    order = sorted((key, n) for _, key, n in best)
    return Splitters(np.array([x[0] for x in order], np.int64), np.array([x[1] for x in order], np.int64), per_shard)


def histogram_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of docs, and shard (0 to shards - 1) and slot (gapless from 0 in its shard).

    Shards are near equal in bytes: each splitter misses its target by the tolerance or by one row at most, unless
    rows agree in text and id: those stay together. Null texts are a group of equal texts. An empty table gives no
    rows. All columns are carried through the one exchange; columns named shard or slot are replaced.
    """
    # ids, hashes and sizes only: the rounds read this narrow table, the texts are read once more for the exchange
    keys = written(docs.select(sort_key().alias("key"), row_size().alias("size")), "shard-keys")
    s = splitters(keys, shards, tolerance)
    shared = docs.sparkSession.sparkContext.broadcast(s)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value.keys, key.to_numpy(), side="right").astype(np.int32))

    rows = np.concatenate([[0], s.rows])
    first = rows - rows[(np.arange(len(rows)) // s.per_shard) * s.per_shard]
    place = docs.sparkSession.createDataFrame(pa.table({"_bucket": np.arange(len(rows), dtype=np.int32), "shard": (np.arange(len(rows)) // s.per_shard).astype(np.int32), "_first": first}))
    held, own = aside(docs.drop("shard", "slot"), ["_key", "_bucket", "_at", "_first"])
    dealt = held.withColumn("_key", sort_key()).withColumn("_bucket", bucket("_key"))
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", "doc_id"))
    numbered = dealt.repartition("_bucket").withColumn("_at", at).join(F.broadcast(place), "_bucket")  # at most MOST_BUCKETS rows
    return numbered.select(*own, "shard", (F.col("_first") + F.col("_at") - 1).cast("long").alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    out = histogram_shards(docs.select("doc_id", "text"), shards)
    return out.select(
        "doc_id", row_size().alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs as Parquet, a folder for each shard; rows of a file stand in the order of their slots."""
    histogram_shards(docs, shards).write.partitionBy("shard").parquet(path)
