"""Places in a linked list that no task holds whole, and sums of what stands before each place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import written


def _rank_few(group: pa.Table) -> pa.Table:
    """Places of the elements that are left, by pointer jumping."""
    ids, place, head = np.asarray(group["id"]), np.asarray(group["gap"]).copy(), np.asarray(group["before"].is_null())
    order = np.argsort(ids)
    to = order[np.searchsorted(ids, np.asarray(group["before"].fill_null(0)), sorter=order).clip(max=len(ids) - 1)]
    to[head] = np.nonzero(head)[0]
    while (to[to] != to).any():
        place += place[to]  # 0 at the head
        to = to[to]
    return pa.table({"id": pa.array(ids, pa.int64()), "place": pa.array(place, pa.int64())})


def rank_list(links: DataFrame, few: int = 32_768) -> DataFrame:
    """(id, place): how many elements stand before each in one list given as (id, next); `next` is null at its end.

    Contraction: in each round the elements whose hash is smaller than those of both neighbours leave - a third of all, as
    expected, and never two in a row - and their neighbours are tied together, with the distance kept. When at most `few`
    are left (a fixed bound, at every size), one task ranks them, and the others get their places back round by round from
    the element they stood behind. All rounds together move a few times the rows of the list.
    """
    none = F.lit(None).cast("long")
    both = links.select("id", "next", none.alias("before")).union(links.where("next is not null").select(F.col("next").alias("id"), none, F.col("id")))
    live = both.groupBy("id").agg(F.max("next").alias("next"), F.max("before").alias("before"))
    live = written(live.withColumn("gap", F.when(F.col("before").isNull(), 0).otherwise(1).cast("long")), "list")
    left: list[DataFrame] = []
    turn = 0
    while live.count() > few:
        own, one, two = (F.xxhash64(c, F.lit(turn)) for c in ("id", "before", "next"))
        leaves = F.col("before").isNotNull() & F.col("next").isNotNull() & (own < one) & (own < two)
        marked = live.withColumn("leaves", leaves)
        gone = written(marked.where("leaves").drop("leaves"), "left")
        stay = marked.where("not leaves").select("id", "next", "before", "gap", none.alias("to"), none.alias("back"), none.alias("more"))
        ahead = gone.select(F.col("before").alias("id"), none, none, none, F.col("next"), none, none)
        behind = gone.select(F.col("next").alias("id"), none, none, none, none, F.col("before"), F.col("gap"))
        met = stay.union(ahead).union(behind).groupBy("id").agg(*[F.max(c).alias(c) for c in ("next", "before", "gap", "to", "back", "more")])
        live = written(met.select("id", F.coalesce("to", "next").alias("next"), F.coalesce("back", "before").alias("before"),
                                  (F.col("gap") + F.coalesce("more", F.lit(0))).alias("gap")), "list")
        left.append(gone)
        turn += 1
    places = live.groupBy(F.lit(0).alias("all")).applyInArrow(_rank_few, "id long, place long")
    for gone in reversed(left):
        places = written(places, "places")
        known = places.select(F.col("id").alias("before"), F.col("place").alias("at"))
        places = places.union(gone.join(known, "before").select("id", (F.col("at") + F.col("gap")).alias("place")))
    return places


def sums_before(rows: DataFrame, columns: list[str], total: int) -> DataFrame:
    """`rows` with each of `columns` replaced by its sum over all smaller `place`s (0 .. total - 1, each once).

    Places are cut into blocks of about the square root of `total`: sums run inside blocks and over the block totals.
    """
    block = max(1, int(total**0.5))
    cut = rows.withColumn("block", F.floor(F.col("place") / block))
    totals = cut.groupBy("block").agg(*[F.sum(c).alias(f"{c}_all") for c in columns])
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("block", *[F.coalesce(F.sum(f"{c}_all").over(over), F.lit(0)).alias(f"{c}_all") for c in columns])
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select(*[c for c in cut.columns if c not in columns], *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in columns])
    both = cut.join(totals, "block")
    return both.select(*[c for c in rows.columns if c not in columns], *[(F.col(c) + F.col(f"{c}_all")).alias(c) for c in columns])
