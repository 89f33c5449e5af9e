"""Byte-level BPE by ranks: encoding in linear time by backtracking from longest matches, and decoding.

Bytes are mapped to the characters of Latin-1, so that the automaton of pyahocorasick holds the tokens and finds the
longest one at any place of a piece. A sequence of tokens is what the merges give exactly if each two adjacent tokens are what they give for their own
bytes; which pairs are is remembered. From the longest token on, shorter ones are taken until the pair fits; a place
from which nothing fits is left for good, so each place is tried once.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and pairs that a worker remembers, at least (twice as many at most).
PIECES, PAIRS = 200_000, 200_000
#: From this many code points on, the pieces of a text are neither listed nor remembered.
LONG = 1 << 20
NO_RANK = 1 << 62


class _Recent(dict):
    """What was computed last for a key: at least `limit` entries, at most twice as many."""

    def __init__(self, compute, limit: int) -> None:
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        self[key] = found
        return found


class ByteBpe:
    """An encoder and decoder by the ranks of tokens, which must hold all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes {missing} have no rank")
        self.ranks, self.of = ranks, {t: b for b, t in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.size = {t: len(b) for b, t in ranks.items()}
        self.longest = max(self.size.values())
        self.tokens = {b.decode("latin-1"): t for b, t in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for b, t in self.tokens.items():
            self.trie.add_word(b, t)
        #: token -> the longest token that is a proper prefix of it, if any
        self.shorter = {t: self.first_token(b[:-1]) for b, t in self.tokens.items() if len(b) > 1}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits = _Recent(self._fit, PAIRS)
        self.pieces = _Recent(lambda piece: array("i", self.encode_piece(piece.encode())).tobytes(), PIECES)

    def _merge(self, piece: bytes, until: int) -> list[bytes]:
        """Merges the pair of least rank, leftmost first, as long as there are more than `until` parts and one has a rank."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > until:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], NO_RANK), k) for k in range(len(parts) - 1))
            if rank == NO_RANK:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def merged(self, piece: bytes) -> list[int]:
        """The merges carried out one by one, in square time: what encode_piece equals for pieces that aren't tokens."""
        return [self.ranks[p] for p in self._merge(piece, 1)]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for bytes and for tokens that merges don't make."""
        if token not in self.halves:
            parts = self._merge(self.of[token], 2)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 and self.size[token] > 1 else None
        return self.halves[token]

    def _fit(self, pair: tuple[int, int]) -> bool:
        """Whether the merges leave the two tokens as they are beside each other.

        The merges that made them are undone at their border, the later one first. The parts that meet there must not
        have a merge of their own that comes before those that took them up; of equal merges the left one is first.
        """
        left, right = pair
        if any(self._halves(t) is None and self.size[t] > 1 for t in pair):
            return False
        until_left = until_right = NO_RANK
        while True:
            rank = self.ranks.get(self.of[left] + self.of[right], NO_RANK)
            if rank < until_left and rank <= until_right and rank != NO_RANK:
                return False
            of_left, of_right = self._halves(left), self._halves(right)
            if of_right and (right >= left or not of_left):
                until_right, right = right, of_right[0]
            elif of_left:
                until_left, left = left, of_left[1]
            else:
                return True

    def first_token(self, text: str) -> int:
        """The longest token that the text (bytes as Latin-1) begins with."""
        n, tokens = self.trie.longest_prefix(text), self.tokens
        while (found := tokens.get(text[:n])) is None:  # what the trie knows may be the beginning of longer tokens only
            n -= 1
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if not piece:
            return []
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        text, n, reach = piece.decode("latin-1"), len(piece), self.longest
        size, fits, shorter, first_token = self.size, self.fits, self.shorter, self.first_token
        out, dead, at, token, before = [], bytearray(n + 1), 0, first_token(text[:reach]), None
        while True:
            end = at + size[token]
            if not dead[end] and (before is None or fits[before, token]):
                out.append(token)
                if end == n:
                    return out
                at, before, token = end, token, first_token(text[end : end + reach])
            elif token in shorter:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else None

    def encode(self, text: str) -> np.ndarray:
        if len(text) < LONG:
            return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.pattern.findall(text))), np.int32)
        pieces = (m.group() for m in self.pattern.finditer(text))
        return np.fromiter(chain.from_iterable(self.encode_piece(p.encode()) for p in pieces), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.of.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def _loaded(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def _added(df: DataFrame, name: str, kind: str) -> str:
    if name in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name} is added by this operator")
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema.fields) + f"{name} {kind}"


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of docs and _ids, the token ids of the whole text by the file of ranks at `path`.

    The file lies at that path on every executor. Null and empty texts have no ids. Rows are treated alone, so repeated rows get the same ids, and special
    tokens' strings are ordinary text.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for b in batches:
            found = [bpe.encode(t.as_py() or "") for t in b.column(b.schema.names.index("text"))]
            ends = np.cumsum([0, *map(len, found)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "_ids"])

    return docs.mapInArrow(task, _added(docs, "_ids", "array<int>"))


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of df and _bytes, what the ids in _ids stand for. Null ids are taken as none; an unknown id is an error."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for b in batches:
            column = b.column(b.schema.names.index("_ids"))
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            data = [bpe.decode(values[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, "_bytes"])

    return df.mapInArrow(task, _added(df, "_bytes", "binary"))


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256."""
    ids = encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "_ids")
    return decode(ids, path, pattern).select(
        "doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("_bytes", 256).alias("decoded_sha256"),
    )
