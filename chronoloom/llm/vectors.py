"""Vector tables: which rows take part, and how they reach numpy."""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITE = float("inf")


def finite(vector: Column) -> Column:
    """True for a vector that is not null, not empty and holds no null, NaN or infinite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INFINITE)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def vector_rows(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) with double components. Rows with a null id or a vector that isn't finite take no part.

    Vectors can only be multiplied at one dimension: the most common one of the table (ties: the smaller); rows of
    another dimension take no part.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal-length lists as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def whole_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(rows of left, rows of right) inner products of whole numbers held as doubles, exact, as 64-bit integers.

    Doubles multiply where the lengths of both vectors show that every sum stays below 2^52, 64-bit integers up to 2^62 and
    Python's integers beyond. A product that doesn't fit is the nearest number of at most 63 bits and a sign.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        sizes = [np.sqrt((x * x).sum(axis=1)) for x in (left, right)]
        most = sizes[0][:, None] * sizes[1][None, :]
        if not most.size or most.max() < 2.0**52:
            return (left @ right.T).astype(np.int64)
        out = np.where(most < 2.0**52, left @ right.T, 0.0).astype(np.int64)
    rows, columns = np.nonzero((most >= 2.0**52) & (most < 2.0**62))
    for a in range(0, len(rows), 4096):
        r, c = rows[a : a + 4096], columns[a : a + 4096]
        out[r, c] = (left[r].astype(np.int64) * right[c].astype(np.int64)).sum(axis=1)
    rows, columns = np.nonzero(~(most < 2.0**62))
    if len(rows):
        edge = 2**63 - 1
        whole = [{i: [int(x) for x in side[i].tolist()] for i in np.unique(at).tolist()} for side, at in ((left, rows), (right, columns))]
        for r, c in zip(rows.tolist(), columns.tolist(), strict=True):
            out[r, c] = max(-edge, min(edge, sum(map(operator.mul, whole[0][r], whole[1][c]))))
    return out


def take_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the `k` largest scores, ties to the smaller id, in that order."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.nonzero(scores >= edge)[0]
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def grid(rows: DataFrame, queries: DataFrame, rows_per_block: int, queries_per_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to a grid of (block, part): each block of rows meets each block of queries once.

    Blocks are hash buckets of the ids, so their size is even; a task holds one block of either side at a time.
    """
    blocks = max(1, -(-rows.count() // rows_per_block))
    parts = max(1, -(-queries.count() // queries_per_block))
    left = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left, right
