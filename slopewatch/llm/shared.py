"""Helpers that several training-data operators use."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of small integers that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only in local mode, where that setting is absent, a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again.

    The lineage ends here: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other characters left alone."""
    return F.translate(c, UPPER, LOWER)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; otherwise the join shuffles both sides.

    For narrow tables of ids and numbers only. `df` should be a written table: it is counted.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def aside(df: DataFrame, taken: list[str]) -> tuple[DataFrame, list[Column]]:
    """df with its columns renamed where they clash with `taken`, and what selects them again under their own names."""
    used = {t.lower() for t in taken}
    names = []
    for i, c in enumerate(df.columns):
        names.append(f"_own_{i}" if c.lower() in used else c)
    own = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*[own(c).alias(n) for c, n in zip(df.columns, names, strict=True)]), [own(n).alias(c) for c, n in zip(df.columns, names, strict=True)]


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last; bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mixed(out + np.uint64(width))
