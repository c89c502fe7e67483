"""Near-duplicate documents by 64-bit fingerprints, joined on Golay-code keys.

The binary Golay code of length 23 is perfect: its 4096 codewords are at distance 7 or more, and every word lies within
distance 3 of exactly one. A word at distance 3 from its codeword lies at distance 4 from five others. A word's keys are
the numbers of all codewords within distance 3 and, if the nearest is at distance 3, of the five at distance 4: one key or
six. Two words that differ in at most two bits always share a key.

A fingerprint is cut into segments of 22, 21 and 21 bits. Where two fingerprints differ in at most two bits, some segment
is the same in both and the next one (in a circle) differs in at most two bits, so it shares a key. A fingerprint is posted
under each (whole segment, key of the next segment): 18 postings at most, each named by 33 or 34 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import slices
from chronoloom.llm.graph import components
from chronoloom.session import written

LENGTH, CHECKS = 23, 11
# Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the binary Golay code.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)


def _remainder(word: int) -> int:
    """The word as a polynomial, modulo the generator."""
    for shift in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - CHECKS)
    return word


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the low 12 bits, of the high 11 bits, errors by syndrome): the errors that lead to near codewords.

    errors[s] holds one pattern of weight 3 or less, then the five of weight 4 if the first has weight 3, else copies of it.
    """
    one = np.array([_remainder(1 << i) for i in range(LENGTH)])
    low, high = (np.bitwise_xor.reduce(np.where(np.arange(1 << len(bits))[:, None] >> np.arange(len(bits)) & 1, bits, 0), axis=1) for bits in (one[:12], one[12:]))
    errors = np.zeros((1 << CHECKS, 6), np.int64)
    held = np.zeros(1 << CHECKS, np.int64)
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            pattern = sum(1 << p for p in places)
            s = int(low[pattern & 4095] ^ high[pattern >> 12])
            if weight < 4:
                errors[s] = pattern
                held[s] = 1 if weight == 3 else 6
            elif held[s] < 6:
                errors[s, held[s]] = pattern
                held[s] += 1
    return low, high, errors


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) numbers of the codewords near each 23-bit word; a word with one near codeword has it six times."""
    low, high, errors = golay_tables()
    return (words[:, None] ^ errors[low[words & 4095] ^ high[words >> 12]]) >> CHECKS


def segment_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct keys of each fingerprint; a key names its kind, a whole segment and a near codeword."""
    parts = [(prints >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1) for first, bits in SEGMENTS]
    rows, keys = [], []
    for kind in range(len(SEGMENTS)):
        near = golay_keys(parts[(kind + 1) % len(SEGMENTS)])
        several = near[:, 0] != near[:, 1]
        whole = (np.int64(kind) << 40) | (parts[kind] << 12)
        for i in range(6):
            at = np.arange(len(prints)) if i == 0 else np.nonzero(several)[0]
            rows.append(at)
            keys.append(whole[at] | near[at, i])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes, words: int, at_once: int = 1 << 16) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's runs of `words` words; 0 without words. A-Z in lower case."""
    parts = text.lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    joined, width = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(parts) - width + 1
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, at_once):
        some = np.array([digest(joined[x:y], 42) for x, y in zip(first[a : a + at_once], last[a : a + at_once], strict=True)], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, print): the fingerprint of each text as a signed 64-bit number; 0 for null texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            found = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, print long")


def postings(classes: DataFrame) -> DataFrame:
    """(key, node, print): each class of equal fingerprints under its keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 10_000):
                part = batch.slice(a, 10_000)
                rows, keys = segment_keys(np.asarray(part.column(1)).view(np.uint64))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(at), part.column(1).take(at)], names=["key", "node", "print"])

    return classes.select("node", "print").mapInArrow(each, "key long, node long, print long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that links (a, b) between rows 0 .. n-1 reach, for each row."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _links_in_lists(group: pa.Table, most: int) -> pa.Table:
    """Links between the fingerprints of several whole posting lists, as a forest: one row at most for each posted row."""
    key, node, bits = (np.asarray(group[c]) for c in ("key", "node", "print"))
    order = np.lexsort((node, key))
    key, node, bits = key[order], node[order], bits[order].view(np.uint64)
    names, row = np.unique(node, return_inverse=True)
    a, b = [], []
    at = np.arange(len(key))
    for shift in range(1, len(key)):
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        if not len(at):
            break
        close = at[np.bitwise_count(bits[at] ^ bits[at + shift]) <= most]
        a.append(row[close])
        b.append(row[close + shift])
    label = _forest(np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)]), len(names))
    child = np.nonzero(label != np.arange(len(names)))[0]
    return pa.table({"a": pa.array(names[label[child]], pa.int64()), "b": pa.array(names[child], pa.int64())})


def links_of_crowded(nodes: DataFrame, bits: int) -> DataFrame:
    """Links among (node, print) without any comparison of pairs.

    Two fingerprints are within two bits of each other exactly if both are within one bit of a common word. A word has 65
    such neighbours, so its group is never larger. For one bit, each fingerprint's 64 neighbours are looked up.
    """
    flips = [F.lit(int(np.uint64(1 << i).astype(np.int64))) for i in range(64)]
    masks = F.array(*([F.lit(0).cast("long")] if bits == 2 else []), *flips)
    near = nodes.select("node", F.explode(F.transform(masks, lambda m: F.col("print").bitwiseXOR(m))).alias("word"))
    if bits == 1:
        other = nodes.select(F.col("node").alias("b"), F.col("print").alias("word"))
        return near.join(other, "word").select(F.col("node").alias("a"), "b").where("a < b")
    met = near.groupBy("word").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    return met.select("a", F.explode("all").alias("b")).where("a != b").distinct()


def link_fingerprints(classes: DataFrame, bits: int = 2, crowd: int = 64, rows_per_task: int = 4_000) -> DataFrame:
    """(a, b): links that join the (node, print) rows at `bits` (1 or 2) or fewer differing bits into the same groups as all pairs would.

    Posting lists of up to `crowd` nodes are compared inside tasks, several lists at a time. The nodes of longer lists
    are linked through the words one bit away, which needs no comparison and gives no large group. Every pair in reach
    shares a list, and a list goes one of the two ways with all of its nodes, so no link is lost.
    """
    if bits not in (1, 2):
        raise ValueError("the keys find pairs that differ in 1 or 2 bits")
    posted = written(postings(classes), "postings")
    crowded = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    hot = written(crowded.select("key"), "crowded")
    groups = max(1, -(-posted.count() // rows_per_task))

    def compare(group: pa.Table) -> pa.Table:
        return _links_in_lists(group, bits)

    listed = posted.join(hot, "key", "left_anti")
    links = listed.groupBy(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("place")).applyInArrow(compare, "a long, b long")
    thronged = posted.join(hot, "key", "left_semi").select("node", "print").distinct()
    return written(links.union(links_of_crowded(thronged, bits)).distinct(), "links")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, crowd: int = 64) -> DataFrame:
    """(doc_id, print, fingerprint, component_id, kept): documents linked where fingerprints differ in at most `bits` bits.

    A text's runs of `words` words (space, tab, line breaks separate; A-Z in lower case) count as often as they occur; with
    fewer words the whole sequence is the one run; a null, empty or blank text has the fingerprint 0, which links like any
    other. `print` is the signed number, `fingerprint` its 16 hex digits. component_id is the smallest doc_id that links
    reach, kept says that it is the document's own. Documents with equal fingerprints are one node, so copies make no
    pairs. A doc_id must stand for one text; its repeated rows are copies. Rows without doc_id have a fingerprint, are linked with nothing,
    have a null component and are kept. Whole texts are read, doc_id and text only; an empty table gives an empty result.
    """
    seen = written(fingerprints(docs, words), "fingerprints")
    numbered = seen.where(F.col("doc_id").isNotNull())
    classes = written(numbered.groupBy("print").agg(F.min("doc_id").alias("node")), "classes")
    groups = components(link_fingerprints(classes, bits, crowd))
    known = classes.join(groups, "node", "left").select(F.col("print").alias("_p"), F.coalesce("component", "node").alias("_g"))
    out = seen.join(known, (F.col("print") == F.col("_p")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "print", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("_g").alias("component_id"),
                      F.col("_g").eqNullSafe(F.col("doc_id")).alias("kept"))
