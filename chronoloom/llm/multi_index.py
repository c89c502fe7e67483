"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each to the nearest of `centroids` centroids, so a pair of centroids
names a cell and a small codebook makes many cells. A query walks the pairs in order of summed distance with a heap
until the cells it has met hold enough entries; those entries are scored on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.vectors import matrix, take_best, vector_rows
from chronoloom.session import written

_FOUND = "query_id long, vec_id long, score double"


def codebook(sample: np.ndarray, centroids: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of a bounded sample; fewer where the sample has fewer distinct rows."""
    points = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:centroids]].copy()
    for _ in range(rounds):
        nearest = assign(sample, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def assign(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2.0 * rows @ centres.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed distance until they hold `enough` entries; counts is (first, second).

    The multi-sequence walk: both lists are sorted; a pair enters the heap when a pair beside it has left it.
    """
    rows, cols = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    near, far = first[rows].tolist(), second[cols].tolist()
    at = counts[np.ix_(rows, cols)].tolist()
    heap, seen, met, cells = [(near[0] + far[0], 0, 0)], {(0, 0)}, 0, []
    while heap and met < enough:
        _, i, j = heapq.heappop(heap)
        if at[i][j]:
            met += at[i][j]
            cells.append(int(rows[i]) * len(far) + int(cols[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(near) and y < len(far) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (near[x] + far[y], x, y))
    return cells


def rerank(entries: pa.Table, queries: pa.Table, k: int, at_once: int = 256) -> pa.Table:
    """The `k` largest inner products of each query among this block's entries in cells that the query has met."""
    out_q, out_id, out_s = [], [], []
    if entries.num_rows and queries.num_rows:
        ids, cells, rows = np.asarray(entries["id"]), np.asarray(entries["cell"]), matrix(entries["v"])
        asked, query_ids = matrix(queries["v"]), queries["id"].to_pylist()
        met = queries["met"].to_pylist()
        for a in range(0, len(query_ids), at_once):
            rough = asked[a : a + at_once] @ rows.T
            for i, line in enumerate(rough, a):
                bits = np.unpackbits(np.frombuffer(met[i], np.uint8), bitorder="little")
                pool = np.nonzero(bits[cells].astype(bool) & (ids != query_ids[i]))[0]
                if len(pool) > 2 * k:  # the product above may differ in its last bits from the one that counts
                    edge = np.partition(line[pool], len(pool) - k)[len(pool) - k]
                    pool = pool[line[pool] >= edge - 1e-9 * (1.0 + abs(edge))]
                exact = (rows[pool] * asked[i]).sum(axis=1)
                best = take_best(exact, ids[pool], k)
                out_q.append(np.full(len(best), query_ids[i]))
                out_id.append(ids[pool][best])
                out_s.append(exact[best])
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    return pa.table({"query_id": join(out_q, pa.int64()), "vec_id": join(out_id, pa.int64()), "score": join(out_s, pa.float64())})


def nearest(df: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, centroids: int = 32,
            share: float = 0.6, sample_rows: int = 20_000, seed: int = 7, rows_per_block: int = 4096, queries_per_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` largest inner products found for each query, ties to smaller ids.

    Queries are the rows whose id is divisible by `every`; every other row is a candidate, and all rows are indexed.
    Codebooks are fitted on at most `sample_rows` rows (the smallest hashes of the ids). A query walks until its cells
    hold `share` of all entries, and at least 256: that is the price of recall on vectors without clusters, see README.
    Null, zero and non-finite vectors and rows without an id take no part; other columns aren't read; an empty table
    gives none. A cell of many entries (repeated vectors) is split over several blocks, so no task holds a whole cell.
    """
    spark = df.sparkSession
    rows = vector_rows(df, vec_id, vector).where(F.exists("v", lambda x: x != 0))
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).select("v").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = np.array([r[0] for r in sample])
    half = max(1, points.shape[1] // 2)
    books = [codebook(points[:, :half], centroids, seed), codebook(points[:, half:], centroids, seed + 1)]
    wide = len(books[1])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            cell = assign(v[:, :half], books[0]) * wide + assign(v[:, half:], books[1]) if len(v) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32), pa.int32())], names=["id", "v", "cell"])

    entries = written(rows.mapInArrow(index, "id long, v array<double>, cell int"), "index")
    held = {r["cell"]: r["count"] for r in entries.groupBy("cell").count().collect()}  # at most centroids^2 rows
    total = sum(held.values())
    counts = np.zeros((len(books[0]), wide), np.int64)
    for c, n in held.items():
        counts[c // wide, c % wide] = n
    # Neighbouring cells share a block; a large cell has several of its own.
    first, splits, block, room = {}, {}, 0, rows_per_block
    for c in sorted(held):
        if held[c] > room and room < rows_per_block:
            block, room = block + 1, rows_per_block
        first[c], splits[c] = block, max(1, -(-held[c] // rows_per_block))
        room -= held[c]
        if room <= 0:
            block, room = block + splits[c], rows_per_block
    enough = max(int(np.ceil(share * total)), 256)
    cells = len(books[0]) * wide

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("met", pa.binary()), ("block", pa.int32())])
        for batch in batches:
            v = matrix(batch.column(1))
            for at in range(batch.num_rows):
                q = v[at]
                met = walk(-(books[0] @ q[:half]), -(books[1] @ q[half:]), counts, enough)
                bits = np.zeros(-(-cells // 8) * 8, np.uint8)
                bits[met] = 1
                packed = np.packbits(bits, bitorder="little").tobytes()
                blocks = sorted({b for c in met for b in range(first[c], first[c] + splits[c])})
                one = batch.slice(at, 1)
                yield pa.RecordBatch.from_arrays([pa.array([one.column(0)[0].as_py()] * len(blocks), pa.int64()),
                                                  pa.array([q.tolist()] * len(blocks), pa.list_(pa.float64())),
                                                  pa.array([packed] * len(blocks), pa.binary()), pa.array(blocks, pa.int32())], schema=schema)

    places = spark.createDataFrame([(c, first[c], splits[c]) for c in sorted(held)], "_cell int, _first int, _splits int")
    asked = entries.where(F.col("id") % every == 0).dropDuplicates(["id"]).select("id", "v")
    parts = max(1, -(-asked.count() // queries_per_block))
    left = entries.join(F.broadcast(places), F.col("cell") == F.col("_cell"))  # a row per cell: at most centroids^2
    left = left.withColumn("block", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_splits"))).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("id", "v", "cell", "block", "part")
    right = asked.mapInArrow(visit, "id long, v array<double>, met binary, block int")
    right = right.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return rerank(a, b, k)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
