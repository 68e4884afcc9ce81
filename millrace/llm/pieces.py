"""Splitting oversized texts at natural boundaries, with overlap.

A text's lines give an array of boundaries (the start of a file, of a change block, of a line), each
with its offset in characters, sorted. A piece ends at the last boundary of the strongest kind that
still fits, found by binary search; the next piece begins ``overlap`` characters before that end.
Where a line alone is too long the cut is a hard one at the limit. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 200

# kinds of cut, the strongest first
KINDS = ("file", "block", "line", "hard")


def line_starts(text: str) -> np.ndarray:
    """Offsets of the lines' starts and of the end of the text: the lengths' prefix sums.

    Lines end by a line feed only; carriage returns belong to the line.
    """
    lengths = [len(x) + 1 for x in text.split("\n")]
    lengths[-1] -= 1
    return np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])


def plan_pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], list[int]]:
    """([(start, end, kind of cut at the end)], [number of each line over the limit, from 1]).

    A text within the limit is one piece. No piece is longer than ``limit``; each after the first
    begins ``overlap`` characters before the end of the one before. File starts are preferred, then
    block starts, then line starts, as long as a piece stays at least half full; lines fill it best.
    A line counts as too long by its characters before the line feed; the last line needs none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    size = len(text)
    if size <= limit:
        return [(0, size, "end")], []
    starts = line_starts(text)
    lengths = np.diff(starts) - 1
    lengths[-1] += 1  # no line feed ends what follows the last one
    long_lines = (np.flatnonzero(lengths > limit) + 1).tolist()
    inner = starts[1:-1]
    files = np.array([i for i in inner.tolist() if text.startswith("diff --git ", i)], np.int64)
    blocks = np.array([i for i in inner.tolist() if text.startswith("@@ ", i)], np.int64)
    kinds = ((files, "file", limit // 2), (blocks, "block", limit // 2), (inner, "line", 0))
    pieces, start, done = [], 0, 0
    while size - start > limit:
        end, kind = start + limit, "hard"
        for offsets, name, least in kinds:
            k = int(np.searchsorted(offsets, start + limit, "right")) - 1
            if k >= 0 and offsets[k] > max(done, start + max(least, overlap)):
                end, kind = int(offsets[k]), name
                break
        pieces.append((start, end, kind))
        done, start = end, end - overlap
    pieces.append((start, size, "end"))
    return pieces, long_lines


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text over ``limit`` characters, and its lines that are too long themselves.

    Columns: ``key``, ``piece_no`` from 0 (null in rows for lines), ``start_pos`` and ``end_pos`` (code
    points, from 0, end exclusive), ``cut`` (kind of the boundary at its end), ``piece`` (its text) and
    ``line_no`` (of a line over the limit, else null). Null, empty and short texts give no row. Texts
    are split whole, however long; repeated rows are split each; other columns are not read.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece_no int, start_pos bigint, end_pos bigint, cut string, piece string, line_no bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            # one text at a time, so that memory holds one text's pieces however many rows a batch has
            for row in range(len(batch)):
                value = batch.column(1)[row].as_py()
                pieces, lines = plan_pieces(value, limit, overlap)
                n, m = len(pieces), len(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array([row] * (n + m), pa.int64())),
                        pa.array([*range(n), *[None] * m], pa.int32()),
                        pa.array([*(p[0] for p in pieces), *[None] * m], pa.int64()),
                        pa.array([*(p[1] for p in pieces), *[None] * m], pa.int64()),
                        pa.array([*(p[2] for p in pieces), *[None] * m], pa.string()),
                        pa.array([*(value[a:b] for a, b, _ in pieces), *[None] * m], pa.string()),
                        pa.array([*[None] * n, *lines], pa.int64()),
                    ],
                    names=[key, "piece_no", "start_pos", "end_pos", "cut", "piece", "line_no"],
                )

    over = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).where(F.length("__text") > limit)
    return over.mapInArrow(run, schema)


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(``key``, ``line_no``): 0 for each text that was split, and the number of each line too long by itself."""
    parts = split_oversized(df, key, text, limit, overlap)
    return parts.where("piece_no = 0 or line_no is not null").select(
        F.col(f"`{key}`"), F.coalesce("line_no", F.lit(0)).cast("bigint").alias("line_no")
    )
