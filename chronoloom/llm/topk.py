"""Exact top-k by inner product: columnar branch-and-bound.

Vectors become whole numbers, floor(scale * x). A task holds a block of candidates in vertical layout (one row of the
array per dimension) and, for a query, adds up products one group of dimensions at a time, largest query components
first. What the rest can still add is at most the product of both rests' norms; candidates that can't reach the k-th
best score seen so far go, and the arrays are compacted. Ties are never cut, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.vectors import grid, matrix, take_best, vector_rows, whole_products
from chronoloom.session import written

DIMENSIONS_AT_ONCE = 8
LARGEST = np.finfo(np.float64).max
_FOUND = "query_id long, vec_id long, score long"


def branch_and_bound(query: np.ndarray, query_id: int, columns: np.ndarray, mass: np.ndarray, ids: np.ndarray, k: int, floor: float,
                     exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the up to `k` best candidates with a score of at least `floor`; `columns` is (dimension, candidate).

    All values are whole numbers. `exact` says that sums of their products and squares stay below 2^52, where double arithmetic
    on them is exact; otherwise doubles only bound, by more than their rounding, and what survives is scored in whole numbers.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    alive = np.nonzero(ids != query_id)[0]
    partial, left = np.zeros(len(alive)), mass[alive].copy()
    with np.errstate(over="ignore", invalid="ignore"):
        # what rounding can do: to a root of exact numbers, or to a partial sum and, through the root, to the mass that is left
        slack = 1.0 if exact else 1.0 + 4.0 * np.sqrt(len(order) * 2.0**-52 * float(query @ query) * mass[alive])
        for start in range(0, len(order), DIMENSIONS_AT_ONCE):
            dims = order[start : start + DIMENSIONS_AT_ONCE]
            block = columns[dims] if len(alive) == columns.shape[1] else columns[np.ix_(dims, alive)]
            partial = partial + query[dims] @ block
            left -= (block * block).sum(axis=0)
            rest = query[order[start + DIMENSIONS_AT_ONCE :]]
            if not len(rest) or floor == -np.inf:
                continue
            reach = partial + np.sqrt(np.maximum(left, 0.0) * float(rest @ rest)) + slack
            keep = ~(reach < floor)  # a bound that overflows cuts nothing
            if not keep.all():
                alive, partial, left = alive[keep], partial[keep], left[keep]
                slack = slack if exact else slack[keep]
            if not len(alive):
                break
    if exact:
        scores = partial.astype(np.int64)
    else:
        scores = whole_products(query[None, :], np.ascontiguousarray(columns[:, alive].T))[0]
    good = scores >= floor
    alive, scores = alive[good], scores[good]
    best = take_best(scores, ids[alive], k)
    return ids[alive[best]], scores[best]


def search_block(candidates: pa.Table, queries: pa.Table, k: int, at_once: int = 1024) -> pa.Table:
    """The `k` best of one block of candidates for each query of one block of queries."""
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    if candidates.num_rows and queries.num_rows:
        ids = np.asarray(candidates["id"], dtype=np.int64)
        vertical = np.ascontiguousarray(matrix(candidates["v"]).T)
        asked = matrix(queries["v"])
        with np.errstate(over="ignore"):
            mass = (vertical * vertical).sum(axis=0)
            largest = np.abs(asked).max(axis=1)
        strips = [(vertical[:, a : a + at_once].copy(), mass[a : a + at_once], ids[a : a + at_once]) for a in range(0, len(ids), at_once)]
        tops = [np.abs(columns).max() for columns, _, _ in strips]
        for query_id, query, most in zip(queries["id"].to_pylist(), asked, largest, strict=True):
            best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
            for (columns, part_mass, part_ids), top in zip(strips, tops, strict=True):
                floor = int(best[-1]) if len(best) >= k else -np.inf
                exact = max(float(most), float(top)) < (2.0**52 / len(vertical)) ** 0.5
                more_ids, more = branch_and_bound(query, query_id, columns, part_mass, part_ids, k, floor, exact)
                best_ids, best = np.concatenate([best_ids, more_ids]), np.concatenate([best, more])
                keep = take_best(best, best_ids, k)
                best_ids, best = best_ids[keep], best[keep]
            found.append((query_id, best_ids, best))
    return pa.table({
        "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64), pa.int64()),
        "vec_id": pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.int64()),
        "score": pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.int64()),
    })


def exact_top_k(df: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, scale: float = 256.0,
                rows_per_block: int = 4096, queries_per_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` highest whole-number inner products of each query, ties to smaller ids.

    Queries are the rows whose id is divisible by `every`; every other row is a candidate. Vectors that are null or hold
    null or non-finite components take no part, nor do rows without an id (see `vector_rows`). Repeated rows of one id
    are candidates each, but never of a query of that id. Other columns aren't read; an empty table gives none. Components
    of any finite size are scored exactly; a score that doesn't fit a long is the nearest number of 63 bits and a sign.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_block(left, right, k)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                values = np.clip(np.floor(scale * matrix(batch.column(1))), -LARGEST, LARGEST)
            width = values.shape[1]
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * width, width or 1, dtype=np.int32)[: batch.num_rows + 1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), pa.float64()))], names=["id", "v"])

    rows = written(vector_rows(df, vec_id, vector).mapInArrow(whole, "id long, v array<double>"), "whole-vectors")
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    left, right = grid(rows, queries, rows_per_block, queries_per_block)
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
