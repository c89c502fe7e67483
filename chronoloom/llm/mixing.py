"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Documents start with rate 1. The rates closest to that in relative entropy, among those that give every source its
target of words and no document more than `most` times, are exp(lambda * size) cut at `most`, with one multiplier per
source. The multipliers solve a convex dual; Newton steps find them, all sources at once, on the table of distinct
(source, size) pairs. Rates are then rounded to whole copies.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import word_count
from chronoloom.session import written

UNIT = 1 << 20  # rates are whole numbers of this part, so all sums are exact and reruns agree
_EXACT = "decimal(38,0)"


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, docs) with target: shares of all words by weight, none above `most` times its source.

    Weights repeat along the sources in code point order, null last. What a source can't take is dealt to the others
    by weight until none is above its bound: sources by bound per weight, ascending, are filled to the bound as long
    as the common level lies above it. One row per source: the only global sort is over that table.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1)
    df = sizes.withColumn("_w", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    here = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(here)
    df = df.withColumn("_level", level)
    common = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everything)
    df = df.withColumn("_at", common["_level"])
    full = F.col("_at").isNull() | (F.col("_cap") <= F.col("_at") * F.col("_w"))
    return df.withColumn("target", F.when(full, F.col("_cap")).otherwise(F.col("_at") * F.col("_w"))).drop("_w", "_cap", "_level", "_at")


def _rate(multiplier, size, scale, most: float):
    """A document's rate in whole UNITs."""
    return F.round(F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), multiplier * size / scale))) * UNIT).cast("long")


def multipliers(hist: DataFrame, goals: DataFrame, most: float = 3.0, tolerance: float = 1e-6) -> DataFrame:
    """(source, multiplier, _scale): the dual solution per source.

    `hist` has (source, size, n) with size > 0; `goals` has source, source_size, docs, target. Newton steps are kept
    inside a bracket that every evaluation narrows, and from the twentieth on every second one halves it, so they always
    converge; a source whose target is its upper bound gets a multiplier at which every rate is `most`. Ends when all
    sources are within `tolerance` of their targets, or their brackets are narrower than what rates can tell apart.
    """
    scale = F.greatest(F.col("source_size") / F.greatest(F.col("docs"), F.lit(1)), F.lit(1.0))
    state = goals.where("source_size > 0 and target > 0").select(
        F.col("source").alias("_src"), "target", scale.alias("_scale"),
        F.when(F.col("target") >= F.lit(most * (1 - 1e-12)) * F.col("source_size"), F.lit(1e9))
        .otherwise(F.round(F.log(F.col("target") / F.col("source_size")), 6)).alias("multiplier"),
        (F.col("target") < F.lit(most * (1 - 1e-12)) * F.col("source_size")).alias("_open"),
        F.lit(-1e6).alias("_low"), F.lit(1e6).alias("_high"))
    state = written(state, "mix-state")
    for turn in itertools.count():
        if state.where("_open").isEmpty():
            break
        z = F.col("size") / F.col("_scale")
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("_scale"), most)
        inside = F.when(rate < int(most * UNIT), rate).otherwise(0)
        words = F.col("size") * F.col("n")
        # the source column is null-safe: a null source is a source of its own
        seen = hist.join(state.where("_open"), F.col("source").eqNullSafe(F.col("_src")))
        sums = seen.groupBy("_src").agg(
            F.sum((rate.cast(_EXACT) * words.cast(_EXACT)).cast(_EXACT)).alias("_f"),
            F.sum((inside * F.round(z * 1024).cast("long")).cast(_EXACT) * words.cast(_EXACT)).cast(_EXACT).alias("_g"))
        sums = sums.select(F.col("_src").alias("_of"), (F.col("_f").cast("double") / UNIT).alias("_f"), (F.col("_g").cast("double") / UNIT / 1024).alias("_g"))
        x = F.col("multiplier")
        low = F.when(F.col("_f") < F.col("target"), x).otherwise(F.col("_low"))
        high = F.when(F.col("_f") > F.col("target"), x).otherwise(F.col("_high"))
        step = x + (F.col("target") - F.col("_f")) / F.when(F.col("_g") > 0, F.col("_g"))
        both = (F.col("_l") > -1e6) & (F.col("_h") < 1e6)
        halved = F.when(both, (F.col("_l") + F.col("_h")) / 2).otherwise(F.when(F.col("_f") < F.col("target"), F.greatest(x * 2, x + 1)).otherwise(F.least(x * 2, x - 1)))
        newton = F.lit(turn < 20 or turn % 2 == 0)
        moved = F.round(F.when(newton & (step > F.col("_l")) & (step < F.col("_h")), step).otherwise(halved), 10)
        met = F.abs(F.col("_f") - F.col("target")) <= F.lit(tolerance) * F.col("target")
        stepped = state.where("_open").join(sums, F.col("_src").eqNullSafe(F.col("_of"))).withColumns({"_l": low, "_h": high})
        stepped = stepped.select("_src", "target", "_scale", F.when(met, x).otherwise(moved).alias("multiplier"),
                                 (~met & (F.col("_h") - F.col("_l") > 1e-9)).alias("_open"), F.col("_l").alias("_low"), F.col("_h").alias("_high"))
        state = written(state.where("not _open").unionByName(stepped), "mix-state")
    return state.select(F.col("_src").alias("source"), "multiplier", "_scale")


def balanced_rates(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, units): each document's rate in UNITs.

    `docs` has doc_id, source and size (words); it is read three times. Documents without words have rate 1. A null
    source is a source of its own, listed last.
    """
    hist = written(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goals = written(targets(sizes, weights, most), "mix-goals")
    solved = multipliers(hist.where("size > 0"), goals, most)
    known = goals.select(F.col("source").alias("_s"), "source_size", "target").join(
        solved.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    rate = F.when(F.col("size") == 0, F.lit(UNIT)).when(F.col("target") <= 0, F.lit(0)).otherwise(
        _rate(F.col("multiplier"), F.col("size"), F.col("_scale"), most))
    joined = docs.select("doc_id", "source", "size").join(known, F.col("source").eqNullSafe(F.col("_s")))
    return joined.select("doc_id", "source", "size", "source_size", "target", rate.cast("long").alias("units"))


PHASES = 32


def copies(rated: DataFrame) -> DataFrame:
    """`rated` with copies: rates rounded to whole copies so that each source's words come near its target.

    Documents of a source stand in order of size (bands of a quarter octave, long ones first); a document takes as many
    copies as whole numbers lie in its stretch of the running sum of rates, the rate rounded down or up. So rounding
    errors of neighbours, which are of like size, cancel. Where the count starts is a free phase: of PHASES phases each
    source takes the one whose words come nearest to its target. Running sums go over buckets of a band (an
    eighth of the square root of the number of rows), then over the buckets of a source, in exact whole numbers. `rated` is read four times; a null doc_id orders first.
    """
    buckets = math.isqrt(rated.count()) // 8 + 1
    band = -F.floor(F.log2(F.col("size") + 1) * 4).cast("int")
    keyed = rated.withColumns({"__band": band, "__b": F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")})
    group = ["source", "__band", "__b"]
    sums = keyed.groupBy(*group).agg(F.sum("units").alias("__u"))
    before = F.sum("__u").over(Window.partitionBy("source").orderBy("__band", "__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"__of_{c}") for c in group], F.coalesce(before, F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group).orderBy(F.desc("size"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = keyed.withColumn("__sum", F.sum("units").over(inside))
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group]
    joined = keyed.join(sums, same[0] & same[1] & same[2])
    ranked = written(joined.select(*rated.columns, (F.col("__before") + F.col("__sum")).alias("__end")), "mix-ranked")

    def taken(phase: str) -> str:
        return f"((__end + {phase}) div {UNIT} - (__end + {phase} - units) div {UNIT})"

    words = [F.sum(F.expr(f"size * {taken(str(k * UNIT // PHASES))}")).alias(f"__w{k}") for k in range(PHASES)]
    tried = ranked.groupBy(F.col("source").alias("__src")).agg(F.max("target").alias("__t"), *words)
    misses = F.array(*[F.struct(F.abs(F.col(f"__w{k}") - F.col("__t")).alias("miss"), F.lit(k * UNIT // PHASES).alias("phase")) for k in range(PHASES)])
    best = tried.select("__src", F.array_min(misses)["phase"].alias("__phase"))
    out = ranked.join(best, F.col("source").eqNullSafe(F.col("__src")))
    return out.select(*rated.columns, F.expr(taken("__phase")).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for documents (doc_id, text, source).

    size: words of the whole text, 0 for a null text. Rows sharing a doc_id are documents of their own. Other columns
    aren't read. An empty table gives an empty result.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-docs")
    return copies(balanced_rates(sized, weights, most))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """`docs` with every row as often as the mix takes it.

    A row is known by 128 bits of hashes of its doc_id, source and text, so rows that share an id, and rows without one, are
    taken as often as the mix says for each of them; rows that are alike in all three take their copies together, in the shape
    of one of them.
    """
    own = [F.xxhash64(F.lit(i), "doc_id", "source", "text") for i in range(2)]
    keyed = docs.withColumn("__key", F.concat(*[F.lpad(F.hex(h), 16, "0") for h in own]))
    mixed = mix(keyed.select(F.col("__key").alias("doc_id"), "source", "text"), weights, most)
    times = mixed.groupBy(F.col("doc_id").alias("__key")).agg(F.sum("copies").cast("int").alias("__copies")).where("__copies > 0")
    joined = keyed.dropDuplicates(["__key"]).join(times, "__key")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
