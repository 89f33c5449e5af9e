"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix at unit boundaries and reordered.

Units are runs of the letters A-Z and a-z, or one other code point. A single full match of `(unit)*` by the regex
library keeps every repetition of its group, so the ends of the group are the ends of all units: their number and
both cuts are read off without stepping through the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.shared import aside

UNITS, LETTERS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*+"), regex.compile("[A-Za-z]*+")
#: Code points that one match takes, about: the ends of a longer text come from several matches, each up to a unit's end.
SPAN = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are transformed, and of those the ones whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20
_ADDED = ["_n", "_form", "_prefix_chars", "_middle_chars", "_output"]


def unit_ends(text: str) -> np.ndarray:
    """The end of every unit of the text, in order."""
    found, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        until = LETTERS.match(text, min(at + SPAN, len(text))).end()  # no run of letters is divided
        found.append(np.array(UNITS.fullmatch(text, at, until).ends(1), np.int64))
        at = until
    return np.concatenate(found)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2^32 that depend on the id only."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(doc_id: int | None, text: str, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output)."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """All columns of docs (doc_id: an integer; text) and _n, _form, _prefix_chars, _middle_chars, _output.

    Null texts count as empty, and empty texts stay plain, as do texts that hold one of the marks. Rows with a null id
    draw as for an empty id. Rows are treated alone, so repeated rows get the same result. Columns of docs with names
    of the added ones are refused; report() and fill_in_middle() rename them meanwhile.
    """
    if taken := sorted(set(_ADDED) & {c.lower() for c in docs.columns}):
        raise ValueError(f"columns {taken} are added by this operator")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(b.schema.names.index("doc_id")), b.column(b.schema.names.index("text"))
            rows = [transformed(i.as_py(), t.as_py() or "", seed, rate, suffix_first) for i, t in zip(ids, texts, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            more = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *_ADDED])

    schema = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return docs.mapInArrow(task, schema + "_n long, _form string, _prefix_chars long, _middle_chars long, _output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from.

    A mark can't begin or end inside another, and transformed texts hold none, so each mark stands in an output once.
    """
    size = len(MIDDLE)
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substr(output, F.char_length(head) + F.lit(size + 1))
    left = F.when(form == "spm", F.substring_index(head, PREFIX, 1)).otherwise(F.substring_index(head, SUFFIX, 1))
    right = F.substr(head, F.char_length(left) + F.lit(size + 1))
    left = F.substr(left, F.lit(size + 1))
    return F.when(form == "plain", output).when(form == "spm", F.concat(right, middle, left)).otherwise(F.concat(left, middle, right))


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with transformed texts; all columns stay, null texts become empty."""
    held, own = aside(docs, _ADDED)
    return transform(held, seed).select(*(F.col("_output").alias("text") if c == "text" else o for c, o in zip(docs.columns, own, strict=True)))


def report(docs: DataFrame, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    d = transform(docs.select("doc_id", "text"), seed)
    return d.select(
        "doc_id", F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix_chars").alias("prefix_chars"), F.col("_middle_chars").alias("middle_chars"),
        F.sha2("_output", 256).alias("output_sha256"), F.sha2(restored(F.col("_output"), F.col("_form")), 256).alias("restored_sha256"),
    )
