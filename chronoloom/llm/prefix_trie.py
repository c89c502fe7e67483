"""The trie of conversation prefixes, measured by an Euler tour.

Conversations that begin with the same turns share nodes. A node is known by its depth and a hash of its turns: a sum of
turn value times base^position modulo a prime, for four primes, so that hashes of parts of a conversation in different
tasks can be put together. The tour enters a node, tours its children one after the other and leaves it: two arcs a node,
each with the arc that follows it. The arcs' places are found by list ranking, and sums over a subtree are differences of
prefix sums at the places of a node's two arcs. No step needs a conversation, the children of a node or a subtree in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import word_count
from chronoloom.llm.list_ranking import rank_list, sums_before
from chronoloom.session import written

# The four largest primes below 2^31, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525, 214013, 1812433253)
HEADS = 3  # turns at most that are taken from another conversation
KINDS = range(len(PRIMES))
_NO_IDS = hashlib.sha256(b"").hexdigest()


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo the prime."""
    out, left, square = np.ones(len(exponents), np.int64), exponents.astype(np.int64), base % prime
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square = square * square % prime
        left = left >> 1
    return out


def turn_values(role: Column, text: Column) -> list[Column]:
    """A number below each prime for a turn, from two 64-bit hashes."""
    one, two = F.xxhash64(role, text), F.xxhash64(F.lit(1), text, role)
    bits = [one, F.shiftrightunsigned(one, 32), two, F.shiftrightunsigned(two, 32)]
    return [F.pmod(b, F.lit(p)) for b, p in zip(bits, PRIMES, strict=True)]


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefix hashes of turns within the part of their conversation that this task holds, in order."""
    part, last, held, sums = TaskContext.get().partitionId(), None, 0, [0] * len(PRIMES)
    for batch in batches:
        conv = np.asarray(batch.column(0))
        n = len(conv)
        if not n:
            continue
        new = np.r_[last is None or conv[0] != last, conv[1:] != conv[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: began in an earlier batch
        going = start < 0
        at = np.arange(n) - start + np.where(going, held - 1, 0)
        columns = []
        for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            term = np.asarray(batch.column(1 + k)) * powers(base, at, prime) % prime
            total = np.cumsum(term)
            before = np.where(going, -sums[k], (total - term)[start])
            after = (total - before) % prime
            columns += [after, (after - term) % prime]
            sums[k] = int(after[-1])
        last, held = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(at), batch.column(1 + len(PRIMES)), *map(pa.array, columns)],
            names=["conv_id", "part", "at", "words", *[f"{c}{k}" for k in KINDS for c in "ax"]])


_RANGED = "conv_id long, part int, at long, words long, " + ", ".join(f"a{k} long, x{k} long" for k in KINDS)


def ranked_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, at, words, a0.., x0..): each turn's place in its conversation, the hash of the turns up to it (a) and before it (x).

    Turns are sorted over all tasks, so a long conversation is cut; what its parts lack is added from the few rows that say
    how many turns, and which sum, the conversation has in the tasks before (two a task at most).
    """
    order = ["conv_id", "turn", "role", "text", "spread"]  # equal turns may stand in any order: `spread` lets them part
    rows = turns.withColumn("spread", F.rand(7))
    number = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(number, *order).sortWithinPartitions(*order)
    local = written(dealt.select("conv_id", *turn_values(F.col("role"), F.col("text")), "words").mapInArrow(_ranged, _RANGED), "ranged")
    ends = local.groupBy("conv_id", "part").agg(F.max(F.struct("at", *[f"a{k}" for k in KINDS])).alias("end"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = ends.withColumn("parts", F.count(F.lit(1)).over(whole)).where("parts > 1")
    cut = cut.select("conv_id", "part", F.coalesce(F.sum(F.col("end.at") + 1).over(before), F.lit(0)).alias("held"), *[F.col(f"end.a{k}").alias(f"a{k}") for k in KINDS])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lifts = [pa.array(powers(b, np.asarray(batch.column(2)), p)) for p, b in zip(PRIMES, BASES, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lifts], names=[*batch.schema.names, *[f"lift{k}" for k in KINDS]])

    kinds = ", ".join(f"a{k} long" for k in KINDS) + ", " + ", ".join(f"lift{k} long" for k in KINDS)
    cut = cut.mapInArrow(shift, f"conv_id long, part int, held long, {kinds}")
    carried = [F.coalesce(F.sum(F.pmod(F.col(f"a{k}") * F.col(f"lift{k}"), F.lit(PRIMES[k]))).over(before), F.lit(0)).alias(f"carry{k}") for k in KINDS]
    cut = cut.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "held", *[f"lift{k}" for k in KINDS], *carried)
    both = local.join(F.broadcast(cut), (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")  # two rows a task at most

    def lifted(name: str, k: int) -> Column:
        return F.pmod(F.col(f"{name}{k}") * F.coalesce(f"lift{k}", F.lit(1)) + F.coalesce(f"carry{k}", F.lit(0)), F.lit(PRIMES[k])).alias(f"{name}{k}")

    return both.select("conv_id", (F.col("at") + F.coalesce("held", F.lit(0))).alias("at"), "words", *[lifted(n, k) for n in "ax" for k in KINDS])


def _key(hashes: list[Column], names: tuple[str, str]) -> list[Column]:
    """Four numbers below 2^31 as two."""
    return [(F.shiftleft(hashes[i], 31) + hashes[i + 1]).alias(n) for i, n in ((0, names[0]), (2, names[1]))]


def members(ranked: DataFrame, conversations: DataFrame, borrowed: Column, lender: Column) -> DataFrame:
    """(depth, k1, k2, p1, p2, conv_id, words, last): each node that a rebuilt conversation passes, with its parent's key.

    A conversation's first `borrowed` turns are replaced by as many first turns of the conversation `lender` (fewer if it has
    fewer). Only `HEADS` turns of a conversation are ever lent, so that a long one isn't copied.
    """
    first = [F.max(F.when(F.col("at") == i, F.struct("words", *[f"a{k}" for k in KINDS], *[f"x{k}" for k in KINDS]))).alias(f"t{i}") for i in range(HEADS + 1)]
    heads = ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *first)
    convs = conversations.join(heads, "conv_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    convs = convs.withColumn("skip", borrowed.cast("int")).withColumn("lender", lender)
    lent = heads.select(F.col("conv_id").alias("lender"), F.col("n").alias("most"), *[F.col(f"t{i}").alias(f"l{i}") for i in range(HEADS)])
    convs = convs.join(lent, "lender", "left").withColumn("taken", F.least("skip", F.coalesce("most", F.lit(0))).cast("int"))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("skip"), F.lit(0)))
    convs = written(convs, "conversations")

    def at_depth(column: str, first_depth: int) -> Column:
        return F.coalesce(*[F.when(F.col("depth") == i + first_depth, F.col(f"l{i}.{column}")) for i in range(HEADS)], F.lit(0).cast("long"))

    start = convs.select("conv_id", "length", *[f"l{i}" for i in range(HEADS)], F.explode(F.sequence(F.lit(0), "taken")).alias("depth"))
    start = start.select("depth", *_key([at_depth(f"a{k}", 1) for k in KINDS], ("k1", "k2")), *_key([at_depth(f"a{k}", 2) for k in KINDS], ("p1", "p2")),
                         "conv_id", at_depth("words", 1).alias("words"), (F.col("depth") == F.col("length")).alias("last"))

    # a turn of its own: the hash of the borrowed turns, and its own prefix less the skipped turns, moved by taken - skip places
    shifts = [F.array(*[F.lit(pow(b, -i, p)) for i in range(HEADS + 1)]) for b, p in zip(BASES, PRIMES, strict=True)]
    own = convs.where("n > skip").select(
        "conv_id", "skip", "taken", "length", *[F.coalesce(*[F.when(F.col("skip") == i, F.col(f"t{i}.x{k}")) for i in range(HEADS + 1)]).alias(f"s{k}") for k in KINDS],
        *[F.coalesce(*[F.when(F.col("taken") == i + 1, F.col(f"l{i}.a{k}")) for i in range(HEADS)], F.lit(0).cast("long")).alias(f"h{k}") for k in KINDS],
        *[F.element_at(shifts[k], F.col("skip") - F.col("taken") + 1).cast("long").alias(f"m{k}") for k in KINDS])

    def moved(name: str, k: int) -> Column:
        past = F.pmod(F.col(f"{name}{k}") - F.col(f"s{k}"), F.lit(PRIMES[k])) * F.col(f"m{k}")
        return F.pmod(past + F.col(f"h{k}"), F.lit(PRIMES[k]))

    depth = (F.col("at") - F.col("skip") + F.col("taken") + 1).cast("int")
    rest = ranked.join(own, "conv_id").where(F.col("at") >= F.col("skip")).withColumn("depth", depth)
    rest = rest.select("depth", *_key([moved("a", k) for k in KINDS], ("k1", "k2")), *_key([moved("x", k) for k in KINDS], ("p1", "p2")),
                       "conv_id", "words", (F.col("depth") == F.col("length")).alias("last"))
    return start.union(rest)


_AT = ["depth", "k1", "k2"]


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, as text; a run may go on in the next row."""
    for batch in batches:
        key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])
        n = key.shape[1]
        if not n:
            continue
        cuts = np.union1d(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1, np.arange(0, n, most))
        ids = batch.column(3).to_pylist()
        ends = [*cuts[1:].tolist(), n]
        at = pa.array(cuts)
        yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(4)], pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts.tolist(), ends, strict=True)])],
                                         names=[*_AT, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come one after the other."""
    node, digest = None, None

    def closed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip([*_AT, "ends"], d, strict=True)) for d in done],
                                          pa.schema([("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())]))

    for batch in batches:
        done = []
        for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, digest.hexdigest()))
            node, digest = key, hashlib.sha256(ids.encode())
        if done:
            yield closed(done)
    if node is not None:
        yield closed([(*node, digest.hexdigest())])


def end_digests(passed: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): SHA-256 of the ascending ids of the conversations that end in a node, joined by commas.

    Ids are sorted over all tasks first, so that a node where very many end is read as a few long pieces, one after the other.
    """
    number = int(passed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = passed.where("last").select(*_AT, "conv_id")
    dealt = ends.repartitionByRange(number, *_AT, "conv_id").sortWithinPartitions(*_AT, "conv_id")
    pieces = dealt.mapInArrow(_pieces, "depth int, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*_AT).sortWithinPartitions(*_AT, "first").mapInArrow(_digests, "depth int, k1 long, k2 long, ends string")


def numbered_nodes(passed: DataFrame) -> DataFrame:
    """One row per node: id, key, smallest member, members, words of the last turn, children, and its parent's id, member and children."""
    nodes = passed.groupBy(*_AT).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
                                     F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(kids, _AT, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"),
                         F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    return written(nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "nodes")


def tour(nodes: DataFrame) -> DataFrame:
    """(id, next): the arcs of the Euler tour; 2 * id enters a node, 2 * id + 1 leaves it.

    Children follow each other in the order of (group, id). A node's children are cut into about the square root of their
    number of groups; order within groups and order of groups are two windows, so that no task holds all children.
    """
    group = F.pmod(F.xxhash64("id"), F.ceil(F.sqrt("siblings")).cast("long"))
    kids = nodes.where("parent is not null").select("parent", group.alias("group"), "id")
    grouped = kids.withColumn("after", F.lead("id").over(Window.partitionBy("parent", "group").orderBy("id")))
    firsts = kids.groupBy("parent", "group").agg(F.min("id").alias("first"))
    by_group = Window.partitionBy("parent").orderBy("group")
    firsts = written(firsts.select("parent", "group", "first", F.lead("first").over(by_group).alias("further"), F.row_number().over(by_group).alias("number")), "groups")
    after = grouped.join(firsts.select("parent", "group", "further"), ["parent", "group"])
    beyond = F.coalesce(2 * F.coalesce("after", "further"), 2 * F.col("parent") + 1)
    leave = after.select((2 * F.col("id") + 1).alias("id"), beyond.alias("next"))
    eldest = firsts.where("number = 1").select(F.col("parent").alias("id"), F.col("first").alias("child"))
    enter = nodes.select("id").join(eldest, "id", "left").select((2 * F.col("id")).alias("id"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("next"))
    root = nodes.where("parent is null").select((2 * F.col("id") + 1).alias("id"), F.lit(None).cast("long").alias("next"))
    return written(enter.union(leave).union(root), "arcs")


def prefix_trie(conversations: DataFrame, borrowed: Column | None = None, lender: Column | None = None) -> DataFrame:
    """One row per prefix node of all conversations, with what its subtree holds.

    `conversations` has conv_id, turn, role and text. Turns are ordered by turn (null first), then role and text; repeated
    rows are turns of their own; a null role or text is empty. `borrowed` and `lender` are expressions of conv_id: how many
    first turns (0 to 3) a conversation takes from which other one in place of its own (none by default). A node is a sequence
    of first turns; the root (depth 0) has none. Returned are conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs (conversations that start with it), n_children, n_leaves (childless nodes in its subtree, itself included),
    saved_tokens (over the subtree, (n_convs - 1) * words of the last turn) and ends_sha256 (of the ids of the conversations
    that end there, ascending, joined by commas). Rows with a null conv_id take no part; other columns aren't read. An empty
    table gives no nodes.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), word_count(F.col("text")).alias("words"))
    ranked = written(ranked_turns(turns), "ranked")
    ids = ranked.select("conv_id").distinct()
    passed = written(members(ranked, ids, F.lit(0) if borrowed is None else borrowed, F.col("conv_id") if lender is None else lender), "members")
    nodes = numbered_nodes(passed)
    places = written(rank_list(tour(nodes)), "places")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    worth = nodes.select((2 * F.col("id")).alias("arc"), leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    arcs = places.withColumnRenamed("id", "arc").join(worth, "arc", "left").fillna(0, ["n_leaves", "saved_tokens"])
    sums = sums_before(arcs, ["n_leaves", "saved_tokens"], places.count())
    enter = F.col("arc") % 2 == 0
    spans = sums.groupBy(F.floor(F.col("arc") / 2).alias("id")).agg(*[
        (F.max(F.when(~enter, F.col(c))) - F.max(F.when(enter, F.col(c)))).alias(c) for c in ("n_leaves", "saved_tokens")])
    ends = end_digests(passed)
    out = nodes.join(spans, "id").join(ends, _AT, "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends", F.lit(_NO_IDS)).alias("ends_sha256"))
