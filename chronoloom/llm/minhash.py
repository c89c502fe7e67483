"""Near-duplicate documents by a signature-coordinate inverted join.

A document's signature has `size` coordinates, each the smallest hash of its shingles under one hash function. Documents
are posted under each (coordinate, value); a pair that collides in at least `least` coordinates is retained and then
confirmed on the full shingle sets. Values that one document alone holds can't collide and are skipped. Of the others a
document is posted only under its rarest ones: two documents with `least` common values share at least one of the
prefixes that leave out `least - 1` values. So common values - a licence line, a template - are mostly never posted.

At similarity 0.8 and 64 coordinates, fewer than 35 collide for about 3 of 10^6 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import WordHashes, mix64, rolling, slices
from chronoloom.llm.graph import components
from chronoloom.session import written


def shingle_set(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; of all words where there are fewer. A-Z in lower case."""
    hashes = known.of(text.lower().split())  # on bytes: ASCII letters and ASCII white space only
    if not len(hashes):
        return hashes
    if len(hashes) < words:
        return mix64(rolling(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(rolling(hashes, words))


def signature(shingles: np.ndarray, multipliers: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set, as signed 32-bit numbers."""
    best = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 8192):
        best = np.minimum(best, (shingles[a : a + 8192] * multipliers[:, None] + addends[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, words: int = 5, size: int = 64, seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, content, sig): set size, digest of the set (null if empty) and signature."""
    rng = np.random.default_rng(seed)
    multipliers = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    addends = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part, texts in slices(batches, 1):
            sets = [shingle_set(t, words, known) for t in texts]
            flat = [signature(s, multipliers, addends) if len(s) else np.empty(0, np.int32) for s in sets]
            ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*flat, np.empty(0, np.int32)]), pa.int32()))],
                names=["doc_id", "n_shingles", "content", "sig"])

    return docs.mapInArrow(each, "doc_id long, n_shingles long, content binary, sig array<int>")


def postings(classes: DataFrame, least: int) -> DataFrame:
    """(node, token): each class under the rarest of its values that others hold too, all but `least` - 1 of them."""
    values = classes.select("node", F.posexplode("sig").alias("at", "value"))
    tokens = values.select("node", F.xxhash64("at", "value").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    prefix = F.slice("held", F.lit(1), F.greatest(F.size("held") - (least - 1), F.lit(0)))
    return held.select("node", F.explode(prefix).alias("t")).select("node", F.col("t.token").alias("token"))


def _collide(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) with at least `least` equal coordinates."""
    one = classes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    two = classes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return pairs.join(one, "a").join(two, "b").where(equal >= least).select("a", "b")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, kept = WordHashes(), None, None
        for part, first in slices(batches, 2, 2_000_000):
            good = []
            for x, y in zip(first, part.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if x != last:  # pairs of one document mostly come one after the other
                    last, kept = x, shingle_set(x, words, known)
                other = shingle_set(y, words, known)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(100 * both >= percent * (len(kept) + len(other) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def linked_sets(left: list[np.ndarray], right: list[np.ndarray], percent: int, at_once: int = 4096) -> np.ndarray:
    """Which sets of `left` and of `right` reach the threshold: intersections of all of them by matrix products.

    Only elements that two sets hold matter; their columns are taken `at_once` at a time.
    """
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(column.max(initial=-1)) + 1, at_once):
        lo, hi = np.searchsorted(column, [a, a + at_once])
        some, rows = column[lo:hi] - a, owner[lo:hi]
        one, mine = np.zeros((len(left), at_once), np.float32), rows < len(left)
        two = np.zeros((len(right), at_once), np.float32)
        one[rows[mine], some[mine]] = 1
        two[rows[~mine] - len(left), some[~mine]] = 1
        common += one @ two.T
    both = common.astype(np.int64)
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def colliding(left: np.ndarray, right: np.ndarray, least: int, at_once: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(row of left, row of right) of the signature pairs that are equal in at least `least` coordinates.

    The rows of `right` are posted under each (coordinate, value). A pair that reaches `least` meets in one of a left row's
    `size - least + 1` shortest lists, so only these are merged; the longer ones are skipped, and what they would add is
    counted on the pairs that were met.
    """
    size = left.shape[1]
    place = np.arange(size, dtype=np.int64) << 32
    lists = (right.view(np.uint32).astype(np.int64) + place).ravel()
    order = np.argsort(lists, kind="stable")
    lists, holder = lists[order], order // size
    wanted = left.view(np.uint32).astype(np.int64) + place
    first = np.searchsorted(lists, wanted)
    length = np.searchsorted(lists, wanted, side="right") - first
    short = np.argsort(length, axis=1, kind="stable")[:, : size - least + 1]
    first, length = np.take_along_axis(first, short, axis=1), np.take_along_axis(length, short, axis=1)
    ends = np.cumsum(length.sum(axis=1))
    found, start = [], 0
    while start < len(left):  # some rows of left at a time, as many as meet about `at_once` entries
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, side="right")))
        n = length[start:stop].ravel()
        at = np.repeat(first[start:stop].ravel() - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        owner = np.repeat(np.repeat(np.arange(start, stop), first.shape[1]), n)
        met = np.unique(owner * len(right) + holder[at])
        for i in range(0, len(met), at_once):
            one, two = np.divmod(met[i : i + at_once], len(right))
            good = (left[one] == right[two]).sum(axis=1) >= least
            found.append(np.stack([one[good], two[good]]))
        start = stop
    both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return both[0], both[1]


def links_within(members: DataFrame, texts: DataFrame, words: int, percent: int, least: int, rows: int = 1024, volume: int = 4_000_000) -> DataFrame:
    """(a, b): links between different components of a community, one for each two components that a task finds linked.

    `members` has node, component, community and sig. A task holds two blocks of a community (at most about `rows` nodes and
    `volume` bytes of text each), or several small communities; it counts collisions on inverted lists, compares the full
    sets of what collides and isn't in one component yet, and returns links, never pairs.
    """
    size = F.octet_length("text")
    rich = members.join(texts, "node").select("node", "component", "community", "sig", "text")
    whole = rich.groupBy(F.col("community").alias("c")).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum(size) / volume)).cast("int").alias("blocks"), F.sum(size).alias("bytes"))
    whole = written(whole, "communities")
    total = whole.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bins = max(1, -(-total // volume))
    rich = rich.join(whole, F.col("community") == F.col("c"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    rich = rich.withColumn("block", block).withColumn("m", F.explode(meets))
    alone = F.col("blocks") == 1
    rich = rich.select(
        F.when(alone, F.pmod(F.xxhash64("community"), F.lit(bins))).otherwise(F.col("community")).alias("place"),
        F.when(alone, F.lit(-1)).otherwise(F.col("m.i")).alias("i"), F.when(alone, F.lit(-1)).otherwise(F.col("m.j")).alias("j"),
        "community", "block", "node", "component", "sig", "text")

    def compare(group: pa.Table) -> pa.Table:
        known, out = WordHashes(50_000), []
        community = np.asarray(group["community"])
        node, component, block = np.asarray(group["node"]), np.asarray(group["component"]), np.asarray(group["block"])
        text = group["text"].cast(pa.binary())
        sigs = np.asarray(group["sig"].combine_chunks().flatten()).reshape(len(node), -1)
        order = np.argsort(community, kind="stable")
        for at in np.split(order, np.nonzero(np.diff(community[order]))[0] + 1):
            blocks = np.unique(block[at])
            one, two = at[block[at] == blocks[0]], at[block[at] == blocks[-1]]
            x, y = colliding(sigs[one], sigs[two], least)
            apart = component[one[x]] != component[two[y]]
            x, y = x[apart], y[apart]
            if not len(x):
                continue
            rows_one, x = np.unique(x, return_inverse=True)
            rows_two, y = np.unique(y, return_inverse=True)
            one, two = one[rows_one], two[rows_two]
            sets = {int(r): shingle_set(text[int(r)].as_py(), words, known) for r in np.union1d(one, two)}
            linked = linked_sets([sets[r] for r in one.tolist()], [sets[r] for r in two.tolist()], percent)[x, y]
            x, y = x[linked], y[linked]
            if len(x):
                ends = np.sort(np.stack([component[one[x]], component[two[y]]]), axis=0)
                first = np.unique(ends, axis=1, return_index=True)[1]
                out.append(np.sort(np.stack([node[one[x[first]]], node[two[y[first]]]]), axis=0))
        found = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return rich.groupBy("place", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, size: int = 64, least: int = 35) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked where 100 * common >= percent * united shingles.

    A document's set holds its distinct runs of `words` words (space, tab, line breaks separate; A-Z in lower case), or
    all its words as one run where there are fewer; without words or text it is empty and linked with nothing.
    component_id is the smallest doc_id that links reach, kept says that it is the document's own. Documents with equal
    sets are one class that goes on as one node, so copies make no pairs. The nodes of each posting list first meet two
    leaders, the same for most lists of a group, and are confirmed where they collide often enough. Lists that share a node
    are one community, so pairs that share a list are always in one. Where that leaves several components in a community,
    tasks hold two blocks of it, merge inverted lists of coordinates, compare the full sets of what collides and return
    links between components only: no join makes a pair of two documents. Whole texts are read, doc_id and text only. A doc_id must stand for one text; repeated rows are copies. Rows without doc_id are linked with nothing,
    have a null component and are kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = written(sketches(docs, words, size), "sketches")
    numbered = seen.where(F.col("doc_id").isNotNull() & F.col("content").isNotNull())
    classes = written(numbered.groupBy("content").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "classes")
    posted = written(postings(classes, least), "postings")
    posted = posted.join(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token"), "token")
    posted = written(posted, "postings")
    nodes = posted.select("node").distinct()
    texts = written(docs.join(nodes, docs["doc_id"] == nodes["node"]).select("node", "text"), "texts")

    order = [F.struct(F.xxhash64("node", F.lit(i)), "node") for i in range(2)]
    leaders = posted.groupBy("token").agg(*[F.min(o).alias(f"m{i}") for i, o in enumerate(order)])
    led = posted.join(leaders, "token").select("node", F.explode(F.array("m0.node", "m1.node")).alias("leader")).where("node != leader")
    pairs = led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    tried = written(_collide(pairs, classes, least), "pairs")
    links = written(_confirm(tried, texts, words, percent), "links")
    groups = components(links)

    stars = posted.join(leaders, "token").select(F.col("node").alias("a"), F.col("m0.node").alias("b")).where("a != b").distinct()
    near = components(stars).select("node", F.col("component").alias("community"))
    placed = nodes.join(groups, "node", "left").join(near, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.coalesce("community", "node").alias("community"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("community").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("community")
    open_ = placed.join(mixed, "community").join(classes.select("node", "sig"), "node")
    more = written(links_within(open_, texts, words, percent, least), "links")
    if not more.isEmpty():
        groups = components(links.union(more))

    known = classes.join(groups, "node", "left").select(F.col("content").alias("_c"), F.coalesce("component", "node").alias("_g"))
    out = seen.join(known, (F.col("content") == F.col("_c")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("_g", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
