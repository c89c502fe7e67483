"""Removal of repeated passages by fixed-block anchors.

A passage of `window` words that occurs twice contains, in either document, a whole block of that document's fixed
grid of `window // 2` (rounded up) words. So a document's blocks are the reference, every rolling run of block size in
every document is a probe, and a block that two places hold is an anchor. Windows over anchors are then compared as
wholes, and runs of repeated windows are the maximal exact repeats.

Probes are far too many to shuffle as rows: a task sorts the hashes it has for each range of the hash space, keeps
differences, and sends their bytes plane by plane, about two bytes a probe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import WordHashes, rolling, slices
from chronoloom.session import written

PROBES_PER_RANGE = 4_000_000
_SECOND = 0xD6E8FEB86659FD93  # base of the second hash of a window


def planes(sorted_values: np.ndarray) -> bytes:
    """Differences of sorted 32-bit numbers, all first bytes, then all second bytes, and so on."""
    steps = np.diff(sorted_values, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _ranges(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each hash (its first bits) and the next 32 bits."""
    part = (hashes >> np.uint64(64 - bits)) if bits else np.zeros(len(hashes), np.uint64)
    return part.astype(np.int64), (hashes >> np.uint64(32 - bits)).astype(np.uint32)


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, content, kept_sha256): word count, digest of the word sequence and digest of the whole text's words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for part, texts in slices(batches, 1):
            words = [t.split() for t in texts]
            joined = [b" ".join(w) for w in words]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(w) for w in words], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(j) for j in joined], pa.binary()),
                pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string())],
                names=["doc_id", "n_words", "content", "kept_sha256"])

    return docs.mapInArrow(each, "doc_id long, n_words long, content binary, kept_sha256 string")


def anchors(docs: DataFrame, block: int, bits: int) -> DataFrame:
    """(doc_id, block): blocks whose words stand in two places at least; a block in 10^3 may be named without cause."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        schema = pa.schema([("part", pa.int64()), ("once", pa.binary()), ("twice", pa.binary()), ("own", pa.binary()),
                            ("doc", pa.binary()), ("at", pa.binary())])
        for part, texts in slices(batches, 1):
            ids = part.column(0).to_pylist()
            runs, own, doc, at = [], [], [], []
            for doc_id, text in zip(ids, texts, strict=True):
                run = rolling(known.of(text.split()), block)
                if len(run):
                    runs.append(run)
                    mine = run[::block]
                    own.append(mine)
                    doc.append(np.full(len(mine), doc_id, np.int64))
                    at.append(np.arange(len(mine), dtype=np.int32))
            if not runs:
                continue
            where, low = _ranges(np.concatenate(runs), bits)
            order = np.lexsort((low, where))
            where, low = where[order], low[order]
            own_where, own_low = _ranges(np.concatenate(own), bits)
            own_order = np.argsort(own_where, kind="stable")
            own_where, own_low = own_where[own_order], own_low[own_order]
            doc_all, at_all = np.concatenate(doc)[own_order], np.concatenate(at)[own_order]
            rows = []
            for p in np.unique(where).tolist():
                a, b = np.searchsorted(where, [p, p + 1])
                c, d = np.searchsorted(own_where, [p, p + 1])
                values, times = np.unique(low[a:b], return_counts=True)
                rows.append((p, planes(values), planes(values[times > 1]), own_low[c:d].tobytes(), doc_all[c:d].tobytes(), at_all[c:d].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def meet(group: pa.Table) -> pa.Table:
        binary = {c: [x for x in group[c].to_pylist() if x] for c in ("once", "twice", "own", "doc", "at")}
        values, times = np.unique(np.concatenate([unplaned(x) for x in binary["once"]]), return_counts=True)
        common = np.concatenate([values[times > 1], *[unplaned(x) for x in binary["twice"]]])
        own = np.frombuffer(b"".join(binary["own"]), np.uint32)
        hit = np.isin(own, common)
        return pa.table({"doc_id": np.frombuffer(b"".join(binary["doc"]), np.int64)[hit], "block": np.frombuffer(b"".join(binary["at"]), np.int32)[hit]})

    return docs.mapInArrow(emit, "part long, once binary, twice binary, own binary, doc binary, at binary").groupBy("part").applyInArrow(
        meet, "doc_id long, block int")


def _candidates(words: int, blocks: np.ndarray, block: int, window: int) -> np.ndarray:
    """Starts of the windows that hold an anchor."""
    mark = np.zeros(max(0, words - window + 1) + 1, np.int32)
    if len(mark) > 1:
        low = np.clip(blocks.astype(np.int64) * block + block - window, 0, len(mark) - 1)
        high = np.clip(blocks.astype(np.int64) * block + 1, 0, len(mark) - 1)
        np.add.at(mark, low, 1)
        np.add.at(mark, high, -1)
    return np.nonzero(np.cumsum(mark[:-1]) > 0)[0]


def repeated_windows(anchored: DataFrame, block: int, window: int, bits: int) -> DataFrame:
    """(doc_id, starts): windows of (doc_id, text, blocks) rows whose word sequence starts in another place too.

    Windows are compared by 128 bits of hash.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        schema = pa.schema([("part", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("doc", pa.binary()), ("at", pa.binary())])
        for part, texts in slices(batches, 1):
            ids, blocks = part.column(0).to_pylist(), part.column(2).to_pylist()
            first, second, doc, at = [], [], [], []
            for doc_id, text, own in zip(ids, texts, blocks, strict=True):
                hashes = known.of(text.split())
                starts = _candidates(len(hashes), np.array(own, np.int64), block, window)
                if len(starts):
                    first.append(rolling(hashes, window)[starts])
                    second.append(rolling(hashes, window, _SECOND)[starts])
                    doc.append(np.full(len(starts), doc_id, np.int64))
                    at.append(starts.astype(np.int32))
            if not first:
                continue
            h, g, d, s = map(np.concatenate, (first, second, doc, at))
            where, _ = _ranges(h, bits)
            order = np.argsort(where, kind="stable")
            where, h, g, d, s = where[order], h[order], g[order], d[order], s[order]
            rows = []
            for p in np.unique(where).tolist():
                a, b = np.searchsorted(where, [p, p + 1])
                rows.append((p, h[a:b].tobytes(), g[a:b].tobytes(), d[a:b].tobytes(), s[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def meet(group: pa.Table) -> pa.Table:
        whole = lambda c, kind: np.frombuffer(b"".join(group[c].to_pylist()), kind)
        h, g, d, s = whole("first", np.uint64), whole("second", np.uint64), whole("doc", np.int64), whole("at", np.int32)
        order = np.lexsort((g, h))
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        d, s = d[twice], s[twice]
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        docs, begin = np.unique(d, return_index=True)
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "starts": pa.ListArray.from_arrays(pa.array([*begin, len(s)], pa.int32()), pa.array(s, pa.int32()))})

    sent = anchored.mapInArrow(emit, "part long, first binary, second binary, doc binary, at binary")
    return sent.groupBy("part").applyInArrow(meet, "doc_id long, starts array<int>")


def spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges [from, to) that repeated windows cover: the document's maximal repeats, joined where they overlap."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.nonzero(np.diff(starts) > window)[0]
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + window).tolist(), strict=True))


def drop_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans): words in a window of `window` words that starts elsewhere too go.

    `docs` has doc_id and text; every whole text is read, a null text has no words. spans are the removed word ranges
    [from, to), null where the whole text or nothing goes (n_removed says which); kept_sha256 is the digest of the kept
    words joined by single spaces. Documents with the same words are one class: all their windows repeat, so a class of
    two or more with at least `window` words goes wholly, and one member stands for it when others are judged.
    A doc_id must stand for one text: rows that repeat a document are copies of it and each gives a row. Rows without
    doc_id are returned as they are and repeat nothing. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = written(profile(docs), "repeat-profile")
    block = (window + 1) // 2
    numbered = seen.where(F.col("doc_id").isNotNull())
    classes = written(numbered.where(F.col("n_words") >= window).groupBy("content").agg(
        F.min("doc_id").alias("member"), F.count(F.lit(1)).alias("copies")), "repeat-classes")

    def ranges(words: int | None) -> int:
        """Bits of the hash that name a range, so that a range has at most about PROBES_PER_RANGE hashes; 8 ranges at least."""
        return max(3, int(np.ceil(np.log2(max(1, (words or 0) / PROBES_PER_RANGE)))))

    bits = ranges(numbered.agg(F.sum("n_words")).first()[0])
    probed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = anchors(probed, block, bits).groupBy("doc_id").agg(F.collect_set("block").alias("blocks"))
    found = found.join(classes.select(F.col("member").alias("doc_id")), "doc_id", "left_semi")
    anchored = written(probed.join(found, "doc_id").select("doc_id", "text", "blocks"), "repeat-anchored")
    # an anchor names at most `block` windows
    few = ranges(anchored.agg(F.sum(F.size("blocks")) * block).first()[0])
    windows = repeated_windows(anchored, block, window, few).groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = anchored.select("doc_id", "text").join(windows, "doc_id")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        schema = pa.schema([("doc", pa.int64()), ("removed", pa.int64()), ("digest", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])
        for part, texts in slices(batches, 1):
            rows = []
            for doc_id, text, starts in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), strict=True):
                words, ranges = text.split(), spans(np.array(starts, np.int64), window)
                kept, last = [], 0
                for a, b in ranges:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                rows.append((doc_id, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), ranges))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    reduced = cut.mapInArrow(reduce, "doc long, removed long, digest string, spans array<array<int>>").dropDuplicates(["doc"])
    copied = classes.where("copies > 1").select(F.col("content").alias("_content"))
    out = seen.join(copied, F.col("content") == F.col("_content"), "left").join(reduced, F.col("doc_id") == F.col("doc"), "left")
    gone = F.col("_content").isNotNull() & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", "kept_sha256")).alias("kept_sha256"),
        F.when(~gone, F.col("spans")).alias("spans"))
