"""Splitting oversized items at natural boundaries (problem 7): a recursive hierarchy of separators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a text may be cut, from the most to the least natural place; a separator stays with the text before it.
SEPARATORS = tuple(re.compile(p) for p in (r"(?:[ \t\r]*\n){3,}\s*|\n(?=(?:ACT|Act|SCENE|Scene|Scena)\b)", r"(?:[ \t\r]*\n){2,}\s*", r"(?<=[.!?])[\"')\]]*\s+", r"(?<=[;:,])\s+|\r?\n", r"\s+"))


def _units(text: str, at: int, end: int, room: int, level: int) -> Iterator[int]:
    """Ends of the units of ``text[at:end]``, each of at most ``room`` code points."""
    stack = [(at, end, level)]
    while stack:
        at, end, level = stack.pop()
        if end - at <= room:
            yield end
        elif level == len(SEPARATORS):
            yield from range(at + room, end, room)
            yield end
        else:
            ends = [m.end() for m in SEPARATORS[level].finditer(text, at, end) if at < m.end() < end] + [end]
            stack += [(a, b, level + 1) for a, b in zip([at, *ends], ends)][::-1]


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text``, each of at most ``limit`` code points; each but the first
    starts exactly ``overlap`` code points before the end of the one before. Units are packed greedily."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    pieces, start, last = [], 0, 0
    for end in _units(text, 0, len(text), limit - overlap, 0):
        if end - start > limit:
            pieces.append((start, last))
            start = last - overlap if last > overlap else 0
        last = end
    pieces.append((start, last))
    return pieces


def _cut_batches(limit: int, overlap: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                cuts = cut_text(text, limit, overlap)
                n = len(cuts)
                for i in range(0, n, 256):  # a very long text leaves in several batches
                    some = cuts[i : i + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(some), schema.field(0).type), pa.array(range(i, i + len(some)), pa.int32()), pa.array([n] * len(some), pa.int32()), pa.array([a for a, _ in some], pa.int64()), pa.array([e - a for a, e in some], pa.int64()), pa.array([text[a:e] for a, e in some], pa.string())], schema=schema)

    return run


def pieces(items: DataFrame, id_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """``(id, piece_no, n_pieces, start_at, n_chars, piece)``; sizes count code points.

    Items within the limit stay in the JVM as one piece. A piece ends at a natural place; the next starts exactly
    ``overlap`` code points before that, as specified, which may be within a word. Dropping the first ``overlap`` code points of every
    later piece and joining the rest gives the text back.

    Edge cases: null texts give no piece, an empty text one empty piece; a text without any natural boundary
    is cut at the limit; a repeated row gives its pieces again, so items should be unique; other columns are
    ignored; an empty table gives no rows; an overlap that is negative or not below the limit is an error.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("piece")).where("piece is not null")
    size = F.length("piece")
    short = rows.where(size <= limit).select("id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start_at"), size.cast("long").alias("n_chars"), "piece")
    kind = dict(rows.dtypes)["id"]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    schema = pa.schema([("id", arrow), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_at", pa.int64()), ("n_chars", pa.int64()), ("piece", pa.string())])
    long = rows.where(size > limit).mapInArrow(_cut_batches(limit, overlap, schema), f"id {kind}, piece_no int, n_pieces int, start_at bigint, n_chars bigint, piece string")
    return short.unionByName(long)
