"""From raw rows to a regular series: bucket aggregation and the gap-free calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.columns import LEVEL_STEPS, bucket, step_back
from chronoloom.operators.frame import by_time


def bucket_aggregate(
    df: DataFrame,
    *,
    ts: str,
    level: str | None,
    keys: Sequence[str] = (),
    means: Sequence[str] = (),
    sums: Sequence[str] = (),
    firsts: Sequence[str] = (),
    first_order: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (keys, bucket): averages, sums and first non-null values in a single hash aggregate.

    Partial aggregation runs before the shuffle, so a key or bucket that holds most raw rows costs one partial row
    per task. Sums of nothing but nulls are 0. `first_order` (default: the timestamp) says which row is first; ties
    are broken by the value itself.
    """
    aggs = [F.avg(c).cast("double").alias(c) for c in means]
    aggs += [F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in sums]
    for c in firsts:
        order = F.struct(*[F.col(o) for o in (first_order or [ts])], F.col(c))
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c))
    if not aggs:
        raise ValueError("nothing to aggregate")
    used = dict.fromkeys([*keys, ts, *means, *sums, *firsts, *(first_order or [])])
    rows = df.select(*used).filter(F.col(ts).isNotNull()).withColumn("__bucket", bucket(ts, level))
    return rows.groupBy(*keys, F.col("__bucket").alias("date")).agg(*aggs)


def fill_calendar(df: DataFrame, *, level: str, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Adds the missing buckets between the first and last one of every key, with NULL in all other columns.

    Each row generates the empty buckets up to its successor, so there is no spine table and no join; the one
    shuffle is by the keys, which every later series window reuses.
    """
    if level not in LEVEL_STEPS:
        raise ValueError(f"unknown bucket level {level!r}")
    others = [c for c in df.columns if c not in keys and c != date]
    following = F.lead(date).over(by_time(keys, date))
    until = F.coalesce(step_back(F.col("__next"), level), F.col(date))
    grid = df.withColumn("__next", following).withColumn(
        "__slot", F.explode(F.sequence(F.col(date), until, F.expr(f"interval {LEVEL_STEPS[level]}")))
    )
    real = F.col("__slot") == F.col(date)
    return grid.select(
        *keys,
        F.col("__slot").alias(date),
        *[F.when(real, F.col(c)).alias(c) for c in others],
    )


def date_range(df: DataFrame, *, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """First and last date of every key."""
    return df.groupBy(*keys).agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))
