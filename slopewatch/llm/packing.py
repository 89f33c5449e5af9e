"""Best-fit packing of documents' token ids into sequences of several permitted lengths.

Documents are encoded by a public tokenizer; those longer than the largest length are cut into pieces. Pieces are dealt
into packing groups of bounded size; in each group, longest pieces first, a piece goes to the fullest open bin that still
holds it. If none does, the bin size with the least cost for each token that it can still receive is opened. A long
sequence costs more than its length, since attention grows with the square, and every sequence has a fixed cost; so
which sizes are worth opening depends on the pieces. The sizes are chosen jointly: each set of permitted lengths is
tried on the whole group, and that with the least total cost is kept. At the end each bin is downsized to the least
permitted length that holds its contents, and its sequence of ids is written with its padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopewatch.llm.shared import small_or_shuffled, written
from slopewatch.llm.token_files import END, TOGETHER, Encoder

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, in tokens: what a batch row costs however short it is.
OVERHEAD = 64
#: Length at which attention costs as much again as all else for each token.
ATTENTION = 8192
#: Pieces of a packing group, and tokens of one for each piece.
GROUP, GROUP_TOKENS = 20_000, 500
#: The id that fills sequences up.
PAD = 0


def cost(length, overhead: float = OVERHEAD, attention: float = ATTENTION):
    """What a sequence of this length costs, in tokens."""
    return length + overhead + length * length / attention


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: float = np.inf, openable: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of pieces with these sizes (each from 1 to the largest length): bin and offset of each piece, length of each bin.

    Pieces of equal size are taken in their order; of equally full bins the one filled last is taken first. Only
    `openable` lengths are opened (all, if None); bins are downsized to any of `lengths`.
    """
    lengths = tuple(sorted(lengths))
    prices = [(c, cost(c, overhead, attention)) for c in sorted(openable or lengths)]
    order = np.argsort(-sizes, kind="stable")
    left = int(sizes.sum())
    rooms: list[int] = []  # distinct free rooms of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    used: list[int] = []
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
        else:
            # what is left may fill the bin: cost over the tokens it can receive
            room = min(((p / min(c, left), c) for c, p in prices if c >= s))[1]
            b = len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += s
        left -= s
        if room > s:
            if (free := room - s) not in open_bins or not open_bins[free]:
                insort(rooms, free)
                open_bins[free] = []
            open_bins[free].append(b)
    return where, offset, np.array(lengths, np.int64)[np.searchsorted(lengths, used)]


def pack_jointly(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest of the packings by each set of openable lengths that holds the largest piece; of equal ones, that with the fewest lengths."""
    lengths = tuple(sorted(lengths))
    most = int(sizes.max(initial=1))
    sets = [s for k in range(1, len(lengths) + 1) for s in combinations(lengths, k) if s[-1] >= most]
    return min((pack(sizes, lengths, overhead, attention, s) for s in sets), key=lambda x: cost(x[2], overhead, attention).sum())


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, largest: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens, part, nth, piece, n_tokens, ids): texts' ids with the end id, cut into pieces.

    part is this task, nth tells rows of the task apart that agree in doc_id and tokens. ids are unsigned 16-bit.
    """
    encoder, part, seen = Encoder(path), TaskContext.get().partitionId(), Counter()
    names = ["doc_id", "tokens", "part", "nth", "piece", "n_tokens", "ids"]
    for batch in batches:
        texts = batch.column(1).fill_null("").cast(pa.large_binary())
        ids = batch.column(0).to_pylist()
        group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // TOGETHER
        for rows in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(group)) + 1):
            out = []
            for i, found in zip(rows.tolist(), encoder.ids([texts[i].as_py() for i in rows.tolist()]), strict=True):
                data = np.append(found, np.uint16(END))
                seen[ids[i], len(data)] += 1
                for k, at in enumerate(range(0, len(data), largest)):
                    cut = data[at : at + largest]
                    out.append((ids[i], len(data), part, seen[ids[i], len(data)], k, len(cut), cut.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)


def sequences_of(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], overhead: int, group: int) -> Iterator[pa.RecordBatch]:
    """Rows come grouped; a group ends where the next begins, or after 4 times its usual pieces or tokens."""
    held: list[pa.Table] = []
    count, tokens, key, part = 0, 0, 0, 0

    def rows() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held).combine_chunks()
        size = t.column("n_tokens").to_numpy()
        where, offset, length = pack_jointly(size, lengths, overhead)
        order = np.lexsort((offset, where))
        ids = [np.frombuffer(x, np.uint16) for x in t.column("ids").take(pa.array(order)).to_pylist()]
        first = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(length)))])
        column = {c: t.column(c).take(pa.array(order)).combine_chunks() for c in ("doc_id", "copy", "piece", "n_tokens")}
        fields = [column["doc_id"], column["copy"], column["piece"], pa.array(column["piece"].to_numpy() * max(lengths)), column["n_tokens"], pa.array(offset[order])]
        pieces = pa.StructArray.from_arrays(fields, names=["doc_id", "copy", "piece", "piece_start", "n_tokens", "bin_offset"])
        for a in range(0, len(length), 500):
            b = min(len(length), a + 500)
            start = np.concatenate([[0], np.cumsum(length[a:b])])
            flat = np.full(start[-1], PAD, np.int32)
            for i in range(first[a], first[b]):
                at = start[where[order[i]] - a] + offset[order[i]]
                flat[at : at + len(ids[i])] = ids[i]
            of = pa.ListArray.from_arrays(pa.array((first[a : b + 1] - first[a]).astype(np.int32)), pieces.slice(first[a], first[b] - first[a]))
            sequences = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([f"{key}-{part}-{k}" for k in range(a, b)], pa.string()), pa.array(length[a:b]), sequences, of], names=["bin_id", "bin_length", "ids", "pieces"])

    for batch in batches:
        groups = batch.column(0).to_numpy()
        size = np.cumsum(batch.column(batch.schema.names.index("n_tokens")).to_numpy())
        # a long group is cut within batches too, so that what is held is bounded
        cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (np.diff(size // (group * GROUP_TOKENS)) > 0)) + 1
        edges = [0, *cuts.tolist(), len(groups)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and (groups[a] != key or count >= 4 * group or tokens >= 4 * group * GROUP_TOKENS):
                yield from rows()
                part, count, tokens, held = (part + 1 if groups[a] == key else 0), 0, 0, []
            elif not held:
                part = 0
            key = int(groups[a])
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
            count += b - a
            tokens += int(size[b - 1] - (size[a - 1] if a else 0))
    if held:
        yield from rows()


def sequences(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group: int = GROUP, tokenizer: str | None = None) -> DataFrame:
    """One row per training sequence: bin_id, bin_length, ids (padded to that length), and pieces, an array of structs
    (doc_id, copy, piece, piece_start, n_tokens, bin_offset) that tell what stands where.

    A document of n ids, its end id included, has ceil(n / largest length) pieces; null and empty texts have their end id
    only, so every row is packed. Rows that repeat an id and a length are told apart by `copy`. Other columns of docs are
    left out, whatever their names. Pieces of a bin stand one after the other from offset 0; no bin holds more
    than its length, which is the least permitted one that fits. The tokenizer's ids must be below 65,536.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    largest = max(lengths)
    schema = "doc_id long, tokens long, part int, nth long, piece long, n_tokens long, ids binary"
    pieces = written(docs.select("doc_id", "text").mapInArrow(lambda b: pieces_of(b, tokenizer, largest), schema), "pack-pieces")
    # rows that agree in id and length: each task's own come after those of the tasks before it
    own = pieces.where("piece = 0").groupBy("doc_id", "tokens", "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = written(own.select(F.col("doc_id").alias("d"), F.col("tokens").alias("t"), F.col("part").alias("p"), upto.alias("before")).where("before > 0"), "pack-before")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tokens") == F.col("t")) & (F.col("part") == F.col("p"))
    numbered = pieces.join(small_or_shuffled(before), same, "left").withColumn("copy", F.col("nth") + F.coalesce("before", F.lit(0)))
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    groups = 1 + max(n // group, tokens // (group * GROUP_TOKENS))
    key = F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)).alias("_group")
    dealt = numbered.select(key, "doc_id", "copy", "piece", "n_tokens", "ids").repartition("_group").sortWithinPartitions("_group", F.desc("n_tokens"), "doc_id", "copy", "piece")
    struct = "struct<doc_id:bigint,copy:bigint,piece:bigint,piece_start:bigint,n_tokens:bigint,bin_offset:bigint>"
    return dealt.mapInArrow(lambda b: sequences_of(b, tuple(lengths), overhead, group), f"bin_id string, bin_length long, ids array<int>, pieces array<{struct}>")


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group: int = GROUP, tokenizer: str | None = None) -> DataFrame:
    """One row per piece, read back from the sequences: doc_id, copy, piece, piece_start, n_tokens, bin_id, bin_length, bin_offset, ids_hash (xxhash64 of its ids)."""
    out = sequences(docs, lengths, overhead, group, tokenizer).select("bin_id", "bin_length", "ids", F.explode("pieces").alias("p"))
    ids = F.slice("ids", F.col("p.bin_offset").cast("int") + 1, F.col("p.n_tokens").cast("int"))
    return out.select("p.doc_id", "p.copy", "p.piece", "p.piece_start", "p.n_tokens", "bin_id", "bin_length", "p.bin_offset", F.xxhash64(ids).alias("ids_hash"))
