"""The six baselines, as window expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.frame import by_time, whole, with_step
from chronoloom.operators.transforms import unbounded_before

# Output names in their declared order.
BASELINES = ("last", "mean_latest", "mean_all", "weight_last", "median_latest", "median")


def _from_recent(recent: Column, k: Column) -> dict[str, Column]:
    """Baselines over the last k entries (nulls skipped by mean and median) of an oldest-first array of
    (position, value) structs, for a k that differs per key."""
    size = F.size(recent)
    take = F.least(k, size)
    used = F.slice(recent, size - take + 1, take)
    vals = F.transform(F.filter(used, lambda s: s["v"].isNotNull()), lambda s: s["v"])
    count = F.size(vals)
    ordered = F.array_sort(vals)
    total = F.aggregate(vals, F.lit(0.0), lambda s, x: s + x)
    mid_low = F.get(ordered, F.floor((count - 1) / 2).cast("int"))
    mid_high = F.get(ordered, F.floor(count / 2).cast("int"))
    ramp = F.aggregate(F.transform(used, lambda s, i: s["v"] * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return {
        "mean_latest": F.try_divide(total, count),
        "median_latest": F.when(count > 0, (mid_low + mid_high) / 2),
        "weight_last": F.try_divide(ramp, take * (take + 1) / 2),
    }


def baseline_forecasts(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    k: int | str,
    keys: Sequence[str] = (),
    date: str = "date",
    max_k: int | None = None,
    models: Sequence[str] = BASELINES,
    with_actual: bool = False,
) -> DataFrame:
    """`k` is the length of the "latest" window: a number, or a column holding one per key (then give `max_k`).
    `with_actual` keeps the true value as `y`.

    Expanding means are prefix sums. Expanding medians are wanted for `horizon` rows only, so they are `horizon`
    conditional medians over the key instead of one per row. All windows share the keys' one shuffle.
    """
    width = int(k) if not isinstance(k, str) else int(max_k or 0)
    if width < 1:
        raise ValueError("the latest window needs at least one row")
    w, w0 = by_time(keys, date), whole(keys)
    carry = [k] if isinstance(k, str) else []
    base = df.select(*keys, date, *carry, F.col(target).cast("double").alias("y"))
    base = with_step(base, keys, horizon, date)
    wide = base.withColumn("mean_all", F.avg("y").over(unbounded_before(keys, date)))
    if "median" in models:
        before = [
            F.percentile(F.when(F.col("__row") <= F.col("__rows") - horizon + s, F.col("y")), F.lit(0.5)).over(w0)
            for s in range(horizon)
        ]
        wide = wide.withColumn("__medians", F.array(*before))
        wide = wide.withColumn("median", F.get("__medians", F.col("step")))
    wide = wide.filter(F.col("__row") > F.col("__rows") - horizon - width)
    new: dict[str, Column] = {"last": F.lag("y", 1).over(w)}
    frame = w.rowsBetween(-width, -1)
    if isinstance(k, str):
        entry = F.struct(F.col("__row").alias("__row"), F.col("y").alias("v"))
        wide = wide.withColumn("__recent", F.collect_list(entry).over(frame))
        new |= _from_recent(F.col("__recent"), F.col(k).cast("int"))
    else:
        new["mean_latest"] = F.avg("y").over(frame)
        new["median_latest"] = F.percentile("y", F.lit(0.5)).over(frame)
        m = F.count(F.lit(1)).over(frame)
        ramp = F.sum(F.col("y") * F.col("__row")).over(frame) - (F.min("__row").over(frame) - 1) * F.sum("y").over(frame)
        new["weight_last"] = F.when((m > 0) & (F.count("y").over(frame) == m), ramp / (m * (m + 1) / 2))
    wide = wide.withColumns(new).filter(F.col("step").isNotNull())
    ids = [*keys, "step", date] + (["y"] if with_actual else [])
    return wide.select(*ids, *models).unpivot(ids, list(models), "model", "pred")
