"""Benchmark decontamination by a broadcast set of n-gram windows.

Words of texts are scanned as numbers: a rolling hash of each window of words is looked up in the sorted hashes of
the benchmark's windows, hits are verified word by word, and the words of every verified window are marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.shared import aside, rolling, written

WIDTH = 10
#: Bytes of benchmark text that are broadcast at a time; a larger benchmark is dealt into parts, scanned for one after the other.
BROADCAST_BYTES = 16 << 20

#: Every byte of a word stays (A-Z as a-z), any other becomes a space. UTF-8 bytes from 0x80 on belong to words.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Windows:
    """The windows of some benchmark items, in arrays: about 20 bytes for each word of the items."""

    number: dict[bytes, int]
    code: np.ndarray
    #: All items' words as numbers, and the ids of the items (None where null).
    words: np.ndarray
    ids: list[int | None]
    #: width -> sorted distinct hashes, where each one's windows begin, their places in `words`, and their items.
    by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[int | None, str]], width: int) -> Windows:
        number: dict[bytes, int] = {}
        parts = [np.fromiter((number.setdefault(x, len(number) + 1) for x in words_of(text or "")), np.int32) for _, text in items]
        words = np.concatenate([np.zeros(0, np.int32), *parts])
        size = np.array([len(w) for w in parts], np.int64)
        code = np.random.default_rng(12345).integers(1, 1 << 63, len(number) + 1, dtype=np.uint64)
        start = np.cumsum(size) - size
        by_width = {}
        for k in np.unique(np.minimum(size[size > 0], width)).tolist():
            of = np.flatnonzero(np.minimum(size, width) == k)
            n = size[of] - k + 1
            place = np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item = np.repeat(of, n).astype(np.int32)
            h = rolling(code[words], k)[place]
            order = np.lexsort((place, h))
            h, place, item = h[order], place[order], item[order]
            again = (h[1:] == h[:-1]) & (item[1:] == item[:-1])  # the same window in one item
            for j in range(k):
                again &= words[place[1:] + j] == words[place[:-1] + j]
            kept = np.concatenate([[True], ~again])
            distinct, first = np.unique(h[kept], return_index=True)
            by_width[k] = distinct, np.append(first, kept.sum()), place[kept], item[kept]
        return cls(number, code, words, [i for i, _ in items], by_width)

    def scan(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, set[int]]]:
        """For each text: its number of words, which of them are hit, the items whose windows occur (those with an id)."""
        words = [words_of(x) for x in texts]
        ends = np.cumsum([len(w) + 1 for w in words])
        get = self.number.get
        ids = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        for w, end in zip(words, ends, strict=True):  # a 0 after each text keeps windows inside of it
            ids[end - 1 - len(w) : end - 1] = [get(x, 0) for x in w]
        hit, items = np.zeros(len(ids) + 1, np.int64), {}
        known = ids > 0
        reach = np.concatenate([[0], np.cumsum(known)])
        for k, (hashes, first, place, item) in self.by_width.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(reach[k:] - reach[:-k] == k)  # all words of the window are the benchmark's
            if not len(at):
                continue
            h = rolling(self.code[ids], k)[at]
            where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[where] == h
            at, where = at[same], where[same]
            n = first[where + 1] - first[where]
            at = np.repeat(at, n)
            e = np.repeat(first[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            equal = np.ones(len(at), bool)
            for j in range(k):  # verified
                equal &= ids[at + j] == self.words[place[e] + j]
            at, e = at[equal], e[equal]
            np.add.at(hit, np.unique(at), 1)
            np.add.at(hit, np.unique(at) + k, -1)
            found = np.stack([np.searchsorted(ends, at, side="right"), item[e]])
            for d, of in np.unique(found, axis=1).T.tolist():
                if self.ids[of] is not None:
                    items.setdefault(d, set()).add(self.ids[of])
        marked = np.cumsum(hit) > 0
        for d, (w, end) in enumerate(zip(words, ends, strict=True)):
            yield len(w), marked[end - 1 - len(w) : end - 1], items.get(d, set())


def removed(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between two of them."""
    raw, keep, at, last = text.encode("utf-8", "surrogatepass"), [], 0, 0
    clean = raw.translate(_TABLE)
    before = False
    for i, word in enumerate(clean.split()):
        start = clean.index(word, at)
        at = start + len(word)
        if hit[i]:
            if not before:
                keep.append(raw[last:start])
            last = at
        before = bool(hit[i])
    keep.append(raw[last:])
    return b"".join(keep).decode("utf-8", "surrogatepass")


def parts_of(benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items with a text, in parts of about `limit` bytes: one part after the other comes to the driver."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(max(1, -(-size // limit)))
    for k in range(n):
        yield [(r[0], r[1]) for r in (rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows).collect()]


def _scan(docs: DataFrame, windows: Windows, again: bool, with_text: bool) -> DataFrame:
    """docs with _words, _hits, _items, _marks (a bit for each word); again: docs have them from other parts of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    added = ["_words", "_hits", "_items", "_marks"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            names = batch.schema.names
            col = batch.column(names.index("text"))
            before = [batch.column(names.index(c)) for c in ("_items", "_marks")] if again else None
            rows = [(0, 0, [], b"", None)] * len(col)
            texts, at, held = [], [], 0

            def take() -> None:
                for i, text, (n, hit, of) in zip(at, texts, w.scan(texts), strict=True):
                    if before:
                        hit = hit | np.unpackbits(np.frombuffer(before[1][i].as_py(), np.uint8), count=n).astype(bool)
                        of = of | set(before[0][i].as_py())
                    rows[i] = n, int(hit.sum()), sorted(of), np.packbits(hit).tobytes(), removed(text, hit) if with_text and hit.any() else text if with_text else None
                texts.clear()
                at.clear()

            for i in range(len(col)):
                if (text := col[i].as_py()) is not None:
                    texts.append(text)
                    at.append(i)
                    held += len(text)
                    if held > 4_000_000:
                        take()
                        held = 0
            take()
            n, hits, of, marks, clean = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            more = [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(of, pa.list_(pa.int64())), pa.array(marks, pa.binary())] + [pa.array(clean, pa.string())] * with_text
            kept = [k for k, c in enumerate(names) if not again or c not in added]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *more], names=[*(names[k] for k in kept), *added, *["_clean"] * with_text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if not again or f.name not in added)
    return docs.mapInArrow(task, schema + ", _words long, _hits long, _items array<bigint>, _marks binary" + ", _clean string" * with_text)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, with_text: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of docs and _words, _hits (numbers of words), _items (of the benchmark); with_text: _clean, the text without its hits.

    Null texts have no words and no hits (and stay null); an empty benchmark hits nothing; items without words have
    no windows, nor have items with a null text. The windows of an item with a null id hit words, but there is no id
    to be named. Rows are never moved; repeated rows get the same result each. A benchmark above `limit` bytes is
    scanned for in parts, after each of which the documents are written.
    """
    out, held = docs, None
    for items in parts_of(benchmark, limit):
        if held is not None:
            out = written(_scan(out, held, out is not docs, False), "scanned")
        held = Windows.of(items, width)
    return _scan(out, held, out is not docs, with_text).drop("_marks")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined), contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, width)
    ids = F.concat_ws(",", F.array_sort(F.transform("_items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_hits").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("_hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit spans cut out of their texts. Columns stay."""
    held, own = aside(docs, ["_words", "_hits", "_items", "_marks", "_clean"])
    if remove == "documents":
        return scan(held, benchmark, width).where("_hits = 0").select(*own)
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    found = scan(held, benchmark, width, with_text=True)
    return found.select(*(F.col("_clean").alias("text") if c == "text" else o for c, o in zip(docs.columns, own, strict=True)))
