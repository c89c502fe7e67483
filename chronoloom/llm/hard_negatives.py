"""Hard negatives for anchors of an embedding table: a secondary sort and one streaming pass.

Scores are inner products of whole numbers, floor(scale * x). Every scored pair that can matter becomes a key of 25 bytes -
anchor, descending score, kind, id, each so that bytes sort like the values - and keys are dealt by anchor and sorted by
`repartitionAndSortWithinPartitions`. An iterator then reads each partition once: a positive opens a window of scores, the
negatives that follow fall into the open windows, and a window closes when it is full or the scores have passed it. What is
held is the open windows of one anchor, at most as many as it has positives.

Which pairs can matter is known before the shuffle. The positives of an anchor are its best rows of the same label, so each
block of candidates sends its best ones. With the positives known, a negative matters only if it is among the best of its
block in some window. Both are exact: a row left out has as many better rows in its own block as are asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.vectors import finite, whole_products
from chronoloom.session import written

_SIGN = 1 << 63
POSITIVE, NEGATIVE = 0, 1
_KEY = ">QQBQ"
_TOP = np.uint64(_SIGN)
OUT = np.iinfo(np.int64).min  # below every score


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    """Keys that sort by anchor, descending score, kind and id."""
    out = np.empty(len(ids), [("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
    out["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ _TOP
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _TOP)
    out["kind"], out["id"] = kind, ids.astype(np.int64).view(np.uint64) ^ _TOP
    flat, width = out.tobytes(), out.dtype.itemsize
    return [flat[i : i + width] for i in range(0, len(flat), width)]


def unpack(key: bytes) -> tuple[int, int, int, int]:
    """(anchor, score, kind, id)"""
    anchor, score, kind, row = struct.unpack(_KEY, key)
    return anchor - _SIGN, (_SIGN * 2 - 1 - score) - _SIGN, kind, row - _SIGN


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """(smallest, largest) negative score with low * score <= 100 * negative <= high * score."""
    return max(-((-low * score) // 100), 1 - _SIGN), min((high * score) // 100, _SIGN - 1)


def place_of(key: bytes) -> int:
    """A number that spreads the anchors of keys over partitions."""
    return (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32


def stream(keys: Iterator[bytes], negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from keys in order."""
    current, open_windows = None, []
    for key in keys:
        anchor, score, kind, row = unpack(key)
        if anchor != current:
            current, open_windows = anchor, []
        if kind == POSITIVE:
            open_windows.append([row, score, *window_of(score, low, high), 0])
            continue
        still = []
        for window in open_windows:
            positive, positive_score, smallest, largest, found = window
            if score < smallest:
                continue
            if score <= largest:
                window[4] = found = found + 1
                yield anchor, positive, found, row, positive_score, score
            if found < negatives:
                still.append(window)
        open_windows = still


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of each row's best allowed column, then the next best, `k` times; ties to the first column."""
    left = np.where(allowed, scores, OUT)
    for _ in range(k):
        at = left.argmax(axis=1)
        rows = np.nonzero(left[np.arange(len(left)), at] > OUT)[0]
        yield rows, at[rows]
        left[rows, at[rows]] = OUT


def _vectors(table: pa.Table) -> list[np.ndarray]:
    """Positions of the rows of each dimension, the rows of a dimension by id."""
    size = np.asarray(pa.compute.list_value_length(table["v"]))
    ids = np.asarray(table["id"])
    order = np.lexsort((ids, size))
    cuts = np.nonzero(np.diff(size[order]))[0] + 1
    return np.split(order, cuts) if len(order) else []


def _matrix(table: pa.Table, rows: np.ndarray) -> np.ndarray:
    column = table["v"].take(pa.array(rows)).combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(rows), -1)


def _meetings(candidates: pa.Table, anchors: pa.Table, at_once: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor rows, candidate rows, scores) for anchors and candidates of one dimension, `at_once` anchors at a time."""
    by_size = {len(candidates["v"][int(rows[0])]): rows for rows in _vectors(candidates)}
    for rows in _vectors(anchors):
        others = by_size.get(len(anchors["v"][int(rows[0])]))
        if others is not None:
            right = _matrix(candidates, others)
            for a in range(0, len(rows), at_once):
                some = rows[a : a + at_once]
                yield some, others, whole_products(_matrix(anchors, some), right)


def _dealt(rows: DataFrame, anchors: DataFrame, rows_per_block: int, anchors_per_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides in a grid of (block, part): each block of rows meets each block of anchors once."""
    blocks = max(1, -(-rows.count() // rows_per_block))
    parts = max(1, -(-anchors.count() // anchors_per_block))
    left = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = anchors.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "part"), right.groupBy("block", "part")


def labelled_vectors(df: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, label, v): whole-number vectors. An id is one row: of repeated rows the one of the smallest label and vector."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("id", "r.label", F.transform("r.v", lambda x: _floor(x * scale)).alias("v"))


def _floor(x: Column) -> Column:
    """The whole number below as a double; numbers of 2^53 and more are whole already and would not all fit a long."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)


def mine(df: DataFrame, label: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, positives: int = 5,
         negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, rows_per_block: int = 4096, anchors_per_block: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives for each anchor and positive.

    Anchors are the rows whose id is divisible by `every`. Higher scores come first, ties go to the smaller id. An anchor's
    positives are its first `positives` other rows of the same label; for each of them the first `negatives` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned, all if fewer. `label` is
    the label as a column expression (default: the column `label`). Rows with a null id or label, or a vector that is null,
    empty or holds null or non-finite components, take no part. Repeated rows of an id are one row (`labelled_vectors`). Rows
    only meet rows of their own dimension. A score that doesn't fit a long counts as the nearest long. Other columns aren't
    read. An anchor without positives, and a positive without negatives in its window, give no rows; so does an empty table.
    """
    rows = written(labelled_vectors(df, F.col("label") if label is None else label, vec_id, vector, scale), "labelled-vectors")
    anchors = rows.where(F.col("id") % every == 0).select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own, for the cogroup

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, asked, wanted = (np.asarray(t[c]) for t in (left, right) for c in ("id", "label"))
        out = [(np.empty(0, np.int64),) * 3]
        for a, c, scores in _meetings(left, right):
            allowed = (labels[c] == wanted[a][:, None]) & (ids[c] != asked[a][:, None])
            out += [(asked[a[r]], ids[c[k]], scores[r, k]) for r, k in _best(scores, allowed, positives)]
        return pa.table({n: pa.array(np.concatenate(x), pa.int64()) for n, x in zip(("id", "positive", "score"), zip(*out, strict=True), strict=True)})

    left, right = _dealt(rows, anchors, rows_per_block, anchors_per_block)
    best = left.cogroup(right).applyInArrow(same_label, "id long, positive long, score long")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "positive"))
    best = best.withColumn("place", place).where(F.col("place") <= positives)
    held = best.groupBy("id").agg(F.collect_list(F.struct("score", "positive")).alias("held"))
    found = written(held.select("id", F.col("held.positive").alias("positive"), F.col("held.score").alias("score")), "positives")
    known = anchors.join(found, "id")

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, asked, wanted = (np.asarray(t[c]) for t in (left, right) for c in ("id", "label"))
        edges = [[window_of(s, low, high) for s in row] for row in right["score"].to_pylist()]
        keys: list[bytes] = []
        for a, c, scores in _meetings(left, right):
            other = labels[c] != wanted[a][:, None]
            taken = np.zeros(scores.shape, bool)
            for i in range(positives):
                span = np.array([edges[r][i] if i < len(edges[r]) else (1, 0) for r in a.tolist()], np.int64).reshape(-1, 2)
                allowed = other & (scores >= span[:, :1]) & (scores <= span[:, 1:])
                for r, k in _best(scores, allowed, negatives):
                    taken[r, k] = True
            r, k = np.nonzero(taken)
            keys += pack(asked[a[r]], scores[r, k], NEGATIVE, ids[c[k]])
        return pa.table({"key": pa.array(keys, pa.binary())})

    left, right = _dealt(rows, known, rows_per_block, anchors_per_block)
    against = left.cogroup(right).applyInArrow(windows, "key binary")

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = np.repeat(np.asarray(batch.column(0)), np.asarray(pa.compute.list_value_length(batch.column(1))))
            scores, ids = (np.asarray(batch.column(i).flatten(), np.int64) for i in (2, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pack(each, scores, POSITIVE, ids), pa.binary())], names=["key"])

    keys = against.union(found.mapInArrow(opening, "key binary"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(partitions, place_of)
    mined = ordered.mapPartitions(lambda part: stream((k for k, _ in part), negatives, low, high))
    return df.sparkSession.createDataFrame(mined, T.StructType([T.StructField(n, T.IntegerType() if n == "rank" else T.LongType()) for n in (
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]), verifySchema=False)
