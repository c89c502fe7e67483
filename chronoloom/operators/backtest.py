"""Rolling-origin helpers: folds, origins, cutoffs, and the way back from differences and scaled values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.frame import by_time, join_keys, whole, with_step


def contiguous_fold(member: Column, folds: int, keys: Sequence[str] = (), date: str = "date") -> Column:
    """Fold number 0..folds-1 of the rows where `member` holds, in time order; the first n mod folds folds get one
    row more. NULL for the other rows."""
    flag = F.when(member, F.lit(1)).otherwise(F.lit(0))
    pos = F.sum(flag).over(by_time(keys, date)) - 1
    n = F.sum(flag).over(whole(keys))
    base, extra = F.floor(n / folds), n % folds
    big = extra * (base + 1)
    in_big = F.floor(pos / (base + 1))
    in_rest = extra + F.floor((pos - big) / F.greatest(base, F.lit(1)))
    return F.when(member, F.when(pos < big, in_big).otherwise(in_rest).cast("int"))


def origins(df: DataFrame, *, horizon: int, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """The newest `horizon` rows with their `step`, and `train_rows`, the number of rows before each."""
    return with_step(df, keys, horizon, date).filter(F.col("step").isNotNull()).withColumn("train_rows", F.col("__row") - 1)


def actuals(
    df: DataFrame, *, target: str, horizon: int, keys: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """(keys, step, y, prev_level, prev_diff): the truth of each origin and what is needed to undo differences."""
    w = by_time(keys, date)
    base = with_step(df.select(*keys, date, F.col(target).cast("double").alias("y")), keys, horizon, date)
    base = base.withColumns(
        {"prev_level": F.lag("y", 1).over(w), "prev_diff": F.lag("y", 1).over(w) - F.lag("y", 2).over(w)}
    )
    return base.filter(F.col("step").isNotNull()).select(*keys, "step", "y", "prev_level", "prev_diff")


def undo_differences(
    preds: DataFrame, truth: DataFrame, *, order: int | str, keys: Sequence[str] = (), pred: str = "pred"
) -> DataFrame:
    """Adds the previous actual level (order 1), or previous difference and level (order 2), to predictions.

    `order` is a number or a column of `preds` that holds 0, 1 or 2 per row.
    """
    k = F.col(order) if isinstance(order, str) else F.lit(int(order))
    joined = join_keys(preds, truth.select(*keys, "step", "prev_level", "prev_diff"), [*keys, "step"])
    level = (
        F.when(k == 0, F.col(pred))
        .when(k == 1, F.col(pred) + F.col("prev_level"))
        .otherwise(F.col(pred) + F.col("prev_diff") + F.col("prev_level"))
    )
    return joined.withColumn(pred, level).select(*preds.columns)


def cutoffs(
    df: DataFrame,
    *,
    initial_days: int,
    horizon_days: int,
    period_days: int | None = None,
    keys: Sequence[str] = (),
    date: str = "date",
) -> DataFrame:
    """(keys, cutoff): evaluation cutoffs stepping back from (last date - horizon) while `initial_days` of history
    remain; the step defaults to half the horizon."""
    step = max(int(period_days or horizon_days // 2), 1)
    span = df.groupBy(*keys).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    newest = F.date_sub("last", horizon_days)
    oldest = F.date_add("first", initial_days)
    count = F.floor(F.datediff(newest, oldest) / step)
    points = F.when(count >= 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0)).cast("int")),
                                            lambda i: F.date_sub(newest, i * step)))
    return span.select(*keys, F.explode(points).alias("cutoff"))


def fold_table(df: DataFrame, folds: int, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """`df` with a `fold` column over all its rows."""
    return df.withColumn("fold", contiguous_fold(F.lit(True), folds, keys, date))

