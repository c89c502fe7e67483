"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows start in blocks. How many rows of each block go to each shard is drawn first, as in dealing cards without
replacement; so shard sizes are exact before a row moves. Each block is then permuted and cut by those counts, the
rows are exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONE_BY_ONE = 1000  # draws this few are made one after the other


def communication_matrix(blocks: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Rows of block i that go to shard j: row sums are the blocks, column sums at most one apart.

    Each row is a multivariate hypergeometric draw from the places left; the rows' joint law is that of a uniform
    permutation cut at the shards' bounds. It needs the blocks' counts only, one after the other.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    total = int(sum(blocks))
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    matrix = np.zeros((len(blocks), shards), np.int64)
    for i, rows in enumerate(blocks):
        places, rest = int(left.sum()), int(rows)
        for j in range(shards):
            others = places - int(left[j])
            matrix[i, j] = _hypergeometric(rng, int(left[j]), others, rest)
            rest -= int(matrix[i, j])
            places = others
        left -= matrix[i]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int, most: int = 10**9) -> int:
    """How many of `draws` rows, taken without replacement, are among the `good` ones: exact at every size.

    numpy's generator takes counts below `most`. Beyond, every row is taken with one probability, on its own; given their
    number, the rows taken are a uniform choice, so taking away or adding what is too much or too little, uniformly again,
    leaves the exact law. Each round has about the square root of the draws of the round before.
    """
    if not draws or not good:
        return 0
    if good < most and bad < most:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    if 2 * draws > total:
        return good - _hypergeometric(rng, good, bad, total - draws, most)
    if draws <= ONE_BY_ONE:
        taken = 0
        for i in range(draws):
            taken += int(rng.integers(total - i)) < good - taken
        return taken
    share = draws / total
    some, others = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    over = some + others - draws
    if over > 0:
        return some - _hypergeometric(rng, some, others, over, most)
    return some + _hypergeometric(rng, good - some, bad - others, -over, most)


def shuffle_shards(df: DataFrame, by: Sequence[str], shards: int = 8, seed: int = 20260101, blocks: int | None = None) -> DataFrame:
    """`df` with shard (0..shards-1) and slot (gapless from 0 in each shard): a uniform shuffle, sizes at most one apart.

    `by` are the columns that identify a row; they decide its random numbers, so reruns and retried tasks agree. Rows
    equal in all of them are exchanged freely, and nulls count as values. An empty table gives an empty result. Blocks
    are hash buckets of whole rows, so a common text or source is spread evenly; by default there are as many as the
    square root of the number of rows, and a shard is sorted in parts of about that size. Read twice.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    rows = df.count()
    blocks = blocks or math.isqrt(rows) + 1
    draw = F.xxhash64(F.lit(seed), *by)
    dealt = df.withColumn("__block", F.pmod(F.xxhash64(draw, F.lit(1)), F.lit(blocks)).cast("int"))
    counts = dict(dealt.groupBy("__block").count().collect())  # a number per block
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards, seed)
    ends = matrix.cumsum(axis=1)
    schema = T.StructType([T.StructField("__of", T.IntegerType()), T.StructField("__ends", T.ArrayType(T.LongType()))])
    cuts = spark.createDataFrame([(b, [int(x) for x in ends[b]]) for b in range(blocks)], schema)
    first = Window.partitionBy("__block").orderBy(F.xxhash64(draw, F.lit(2)), *by)
    ranked = dealt.withColumn("__rank", F.row_number().over(first) - 1)
    shard = F.size(F.filter("__ends", lambda end: end <= F.col("__rank")))
    ranked = ranked.join(cuts, F.col("__block") == F.col("__of")).withColumn("shard", shard.cast("int"))
    # The second permutation: a shard is cut into parts by its random number, so no task sorts a whole shard.
    parts = math.isqrt(rows // shards) + 1
    number = F.xxhash64(draw, F.lit(3))
    exchanged = ranked.withColumn("__part", F.pmod(F.shiftright(number, 20), F.lit(parts)).cast("int"))
    sizes = exchanged.groupBy(F.col("shard").alias("__s"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__s", "__p", F.coalesce(before, F.lit(0)).alias("__before"))
    second = Window.partitionBy("shard", "__part").orderBy(number, *by)
    placed = exchanged.withColumn("__in", F.row_number().over(second) - 1)
    placed = placed.join(sizes, (F.col("shard") == F.col("__s")) & (F.col("__part") == F.col("__p")))
    return placed.select(*df.columns, "shard", (F.col("__in") + F.col("__before")).cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; files hold consecutive slots in order, and their names sort in that order.

    Rows are spread by ranges of (shard, slot), so a shard is written by as many tasks as its size asks for.
    """
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
