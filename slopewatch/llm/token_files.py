"""Token ids of documents in files of compressed segments.

Documents are put in order of doc_id by one range exchange and encoded by a public tokenizer; their ids are written
in segments, rows of a Parquet table: the part and number of the segment, the doc_ids and lengths of its documents,
and the ids as the coder in `id_coder` writes them. Segments hold whole documents and can be read one by one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.llm.id_coder import decode, encode
from slopewatch.llm.shared import small_or_shuffled, written

#: Ids of a segment, at least (the last of a part has what is left); a document is never divided.
SEGMENT = 4_000_000
#: Bytes of texts that are encoded together, about.
TOGETHER = 1_000_000
#: The end id that follows each document.
END = 2


def _classes() -> np.ndarray:
    """Of each byte: 0 blanks that divide pieces, 1 letters, 2 digits, 3 other plain signs, 4 what makes a piece not plain."""
    out = np.full(256, 4, np.uint8)
    out[33:127] = 3
    out[[10, 32]], out[[39, 124]] = 0, 4
    out[48:58] = 2
    out[65:91] = out[97:123] = 1
    return out


def _byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: itself if it is seen in print, else the next one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in seen else next(others)) for b in range(256)]


class Encoder:
    """Ids of texts by a tokenizer that lower-cases, and never joins what blanks or line feeds divide: each distinct part is encoded once.

    Plain pieces between blanks are divided into the tokenizer's words here (letters, single digits, runs of other
    signs), and each word is encoded by the tokenizer's model. Plain are ASCII signs and the letters from U+00C0 to
    U+00FF. All other pieces go through the whole tokenizer. Apostrophes begin words of their own, and a bar may belong
    to a special token: such pieces aren't plain.
    """

    LIMIT = 120_000
    CLASS, PLAIN = _classes(), re.compile(rb"(?:[!-&(-{}~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
    SIGNS = dict(enumerate(_byte_signs()))

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.found, self.starts = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def learn(self, new: list[bytes]) -> None:
        """Ids of words and pieces, after those known."""
        model, plain = self.tokenizer.model, [self.PLAIN.fullmatch(x) is not None for x in new]
        ids = [array("H", [t.id for t in model.tokenize(x.decode("latin-1").translate(self.SIGNS))]).tobytes() if p else b"" for x, p in zip(new, plain, strict=True)]
        others = [k for k, p in enumerate(plain) if not p]
        for a in range(0, len(others), 10_000):
            part = others[a : a + 10_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([new[k].decode() for k in part], add_special_tokens=False), strict=True):
                ids[k] = array("H", e.ids).tobytes()
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        self.found = np.concatenate([self.found, np.frombuffer(b"".join(ids), np.uint16)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of UTF-8 texts, which are taken together: a few megabytes at a time."""
        joined = np.frombuffer(b"\n".join([b"", *texts]), np.uint8)
        kind = self.CLASS[joined]
        lead = np.flatnonzero(joined[:-1] == 0xC3)
        tail = joined[lead + 1]
        letter = lead[((tail & 0xC0) == 0x80) & ((tail & 0x9F) != 0x97)]
        kind[letter] = kind[letter + 1] = 1
        first = np.empty(len(kind), bool)
        first[:1], first[1:] = False, kind[1:] != kind[:-1]
        first |= kind == 2
        upper = (joined - np.uint8(65)) < 26
        upper[letter[joined[letter + 1] < 0x9F] + 1] = True
        if (odd := np.flatnonzero(kind == 4)).size:
            piece = np.cumsum(kind == 0)
            bad = np.zeros(piece[-1] + 1, bool)
            bad[piece[odd]] = True
            whole = bad[piece]
            upper &= ~whole
            after = np.concatenate([[False], kind[:-1] == 0])
            first = np.where(whole, after, first)
        kept = kind != 0
        first &= kept
        data = (joined | (upper.view(np.uint8) << 5))[kept]
        at = np.flatnonzero(first[kept]).astype(np.int32)
        n = len(at)
        words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(at, np.int32(len(data)))), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.LIMIT:
            self.forget()
        if new := [x for x in distinct if x not in self.known]:
            self.learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        starts = self.starts[numbers]
        sizes = self.starts[numbers + 1] - starts
        ends = np.cumsum(sizes)
        out = self.found[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if n else 0)]
        until = np.searchsorted(np.flatnonzero(first), np.cumsum([len(t) + 1 for t in texts]) + 1)  # words before each text's end
        return np.split(out, np.concatenate([[0], ends])[until[:-1]]) if texts else []


def segments(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of the files: (doc_id, text)."""
    encoder, part, number = Encoder(path), TaskContext.get().partitionId(), 0
    docs, held, total = [], [], 0

    def row() -> pa.RecordBatch:
        data = encode(np.concatenate(held))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([total], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([data], pa.binary())],
            names=["part", "number", "n_tokens", "doc_ids", "lengths", "ids"],
        )

    for batch in batches:
        texts = batch.column(1).fill_null("").cast(pa.large_binary())
        ids = batch.column(0).to_pylist()
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // TOGETHER
        for rows in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(size)) + 1):
            for i, found in zip(rows.tolist(), encoder.ids([texts[i].as_py() for i in rows.tolist()]), strict=True):
                docs.append(ids[i])
                held.append(np.append(found, np.uint16(end)))
                total += len(held[-1])
                if total >= SEGMENT:
                    yield row()
                    docs, held, total, number = [], [], 0, number + 1
    if docs:
        yield row()


def write_ids(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """The written table of segments of all documents (doc_id, text), in ascending order of doc_id (nulls first).

    Null texts count as empty: they have the end id only. Rows that repeat an id follow each other, in the order of a
    hash of their texts. The range exchange also takes that hash, so rows of one id can be divided.
    """
    order = ["doc_id", F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(lambda b: segments(b, tokenizer, end), "part int, number int, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, ids binary"), "token-segments")


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, number, at, doc_id, n_tokens, ids_crc32) of the documents in each segment, from its decoded ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            part, number, docs, lengths, data = (batch.column(k)[i].as_py() for k in range(5))
            ids = decode(data).astype("<u4")
            ends = np.cumsum(lengths)
            if len(ids) != (ends[-1] if lengths else 0):
                raise ValueError("a segment's lengths differ from its ids")
            sums = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths, strict=True)]
            k = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * k, pa.int32()), pa.array([number] * k, pa.int32()), pa.array(ends - np.array(lengths, np.int64), pa.int64()), pa.array(docs, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["part", "number", "at", "doc_id", "n_tokens", "ids_crc32"],
            )


def report(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    files = write_ids(docs, tokenizer, end)
    sizes = files.select("part", "number", "n_tokens")
    # ids before each part (a row for each part of the files), then before each segment of it
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    starts = written(sizes.select("part", "number", within.alias("within")).join(before, "part").select("part", "number", (F.col("within") + F.col("before")).alias("base")), "token-starts")
    found = files.select("part", "number", "doc_ids", "lengths", "ids").mapInArrow(documents_of, "part int, number int, at long, doc_id long, n_tokens long, ids_crc32 long")
    return found.join(small_or_shuffled(starts), ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
