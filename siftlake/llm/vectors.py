"""Integer vectors for exact search: quantising, common figures, matrices of Arrow list columns."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlake.llm import common

#: Above this, sums of products are no longer exact as doubles.
EXACT = float(1 << 52)
#: Bytes of a block's vectors as doubles, at least and at most.
LEAST_BYTES, MOST_BYTES = 4 << 20, 64 << 20


class Figures(NamedTuple):
    """Rows, components of the longest vector (1 at least), the largest component in size, the greatest length."""

    rows: int
    dims: int
    largest: int
    norm: float


def quantised(vectors: DataFrame, scale: int, *keep: str) -> DataFrame:
    """Rows (*keep, v array<long>, norm double): v holds floor(scale * x) of every component. Vectors that are null or hold
    null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))), F.lit(False))
    rows = vectors.where(sound).select(*keep, F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e)).alias("v"))
    squares = F.aggregate(F.transform("v", lambda e: e.cast("double") * e.cast("double")), F.lit(0.0), lambda a, e: a + e)
    return rows.withColumn("norm", F.sqrt(squares))


def figures(rows: DataFrame) -> Figures:
    most = F.max(F.array_max(F.transform("v", lambda e: F.greatest(e, F.bitwise_not(e)))))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), most.alias("m"), F.max("norm").alias("norm")).first()
    return Figures(got.n, max(got.d or 0, 1), got.m or 0, got.norm or 0.0)


def block_rows(f: Figures, parts: int) -> int:
    """Rows of a block: a `parts`-th of the table, within the bounds of a block's bytes."""
    width = 8 * f.dims
    return max(64, min(max(f.rows // parts, LEAST_BYTES // width), MOST_BYTES // width))


def narrow(rows: DataFrame, f: Figures) -> DataFrame:
    """The same with 32-bit components where they fit."""
    return rows.withColumn("v", F.col("v").cast("array<int>")) if f.largest < 1 << 31 else rows


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A list column as int64 rows of `dims` components; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(first, lengths)] = flat
    return out


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """64-bit ids, a null one as the greatest: it comes last among equals."""
    return column.fill_null(common.NO_ID).to_numpy().astype(np.int64)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == common.NO_ID)


def ranked_rows(rows: DataFrame, order: list[str], name: str, out: str) -> DataFrame:
    """`rows` numbered in the order of all rows; equal rows keep the order of the written table."""
    rows = common.written(rows, name).withColumn("_row", F.monotonically_increasing_id())
    return common.numbered(rows, [*order, "_row"], name, out).drop("_row")
