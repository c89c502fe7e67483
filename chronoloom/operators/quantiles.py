"""Exact quantiles of groups of any size, by rounds of range counts.

`percentile` holds all values of a group in one buffer. Here a round takes splitters of an interval from a sketch of bounded
size, counts the values between them, and goes on with the range that holds the wanted rank, cut to the values found in
it; once that has few distinct values, these are put in order. The sketch says where to count, never what the result is. No
task ever holds more than a fixed number of values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.frame import join_keys
from chronoloom.session import cut_lineage

BINS = 64  # ranges of a round
SKETCH = 2000  # accuracy of the splitters: at most about this many values in a buffer
AT_MOST = 4096  # distinct values that a group may hold in order
SALTS = 16  # parts in which the values of one key meet its intervals


def _within(values: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of every interval in `state`, which has few rows a key."""
    parts = state.drop("__rank", "__distinct").distinct()
    parts = parts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = join_keys(values.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SALTS)).cast("int")), parts, [*keys, "__salt"])
    return met.filter(F.col("__v").between(F.col("__from"), F.col("__to"))).drop("__salt")


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], keys: Sequence[str] = (), *, bins: int = BINS, at_most: int = AT_MOST
) -> DataFrame:
    """(keys, n, quantiles): the number of known values and, in the order of `probabilities`, the quantiles with linear interpolation.

    NULL and NaN are unknown; a key without known values has n = 0 and NULL quantiles. A NULL key is a key. Infinities are values
    like others, but nothing lies between one and another value: there the quantile is the nearer of the two.
    """
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    if bins < 2 or at_most < 1:
        raise ValueError("a round needs 2 ranges or more, a group one value or more")
    keys, v = list(keys), F.col(column).cast("double")
    # one row a value, spread by value: a hot key, or a hot value, is a count from here on
    values = df.select(*keys, F.when(~F.isnan(v), v + F.lit(0.0)).alias("__v")).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__m"))
    values = cut_lineage(values)
    known = F.col("__v").isNotNull()
    whole = values.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(known, F.col("__m"))), F.lit(0)).alias("n"), F.count("__v").alias("__distinct"),
        F.min("__v").alias("__from"), F.max("__v").alias("__to"))
    whole = cut_lineage(whole)
    values = values.filter(known)

    place = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(c).cast("long") for c in place for f in (F.floor, F.ceil)]))
    state = whole.filter(F.col("n") > 0).select(
        *keys, F.explode(ranks).alias("__rank"), "__from", "__to", F.lit(0).cast("long").alias("__below"), "__distinct")
    at = [*keys, "__from", "__to", "__below"]
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    done = []
    while True:
        state = cut_lineage(state)
        few = F.col("__distinct") <= at_most
        done.append(state.filter(few))
        state = state.filter(~few)
        if state.isEmpty():
            break
        splits = _within(values, state, keys).groupBy(*at).agg(F.percentile_approx("__v", shares, SKETCH).alias("__splits"))
        # the least value is a splitter too: two values or more are always parted
        splits = splits.withColumn("__splits", F.array_distinct(F.concat(F.array("__from"), "__splits")))
        split = _within(values, cut_lineage(splits), keys)
        range_of = F.size(F.filter("__splits", lambda x: x < F.col("__v")))
        counted = split.groupBy(*at, range_of.alias("__range")).agg(
            F.sum("__m").alias("__m"), F.count(F.lit(1)).alias("__d"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        up_to = F.sum("__m").over(Window.partitionBy(*at).orderBy("__range"))
        counted = counted.withColumn("__under", F.col("__below") + up_to - F.col("__m"))
        met = join_keys(state.drop("__distinct"), counted, at)
        met = met.filter((F.col("__under") <= F.col("__rank")) & (F.col("__rank") < F.col("__under") + F.col("__m")))
        state = met.select(
            *keys, "__rank", F.col("__least").alias("__from"), F.col("__most").alias("__to"), F.col("__under").alias("__below"), F.col("__d").alias("__distinct"))
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    up_to = F.sum("__m").over(Window.partitionBy(*at).orderBy("__v"))
    ordered = _within(values, last, keys).withColumn("__under", F.col("__below") + up_to - F.col("__m"))
    found = join_keys(last.select(*at, "__rank"), ordered, at)
    found = found.filter((F.col("__under") <= F.col("__rank")) & (F.col("__rank") < F.col("__under") + F.col("__m")))
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))  # two ranks a probability

    def between(c):
        low, high = (F.try_element_at("__at", f(c).cast("long")) for f in (F.floor, F.ceil))
        part = c - F.floor(c)
        endless = (F.abs(low) == float("inf")) | (F.abs(high) == float("inf"))
        return F.when(low == high, low).when(endless, F.when(part <= 0.5, low).otherwise(high)).otherwise(low * (1 - part) + high * part)

    left = whole.select(*keys, "n")
    out = join_keys(left, found, keys, "left") if keys else left.join(F.broadcast(found), how="left")  # without keys, one row each
    return out.select(*keys, "n", F.array(*[between(c) for c in place]).alias("quantiles"))
