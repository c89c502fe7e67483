"""Order and position helpers shared by the operators.

A *series* is a frame unique on (keys, date) after bucketing. One key then has at most one row per calendar
bucket, so a window partitioned by the keys is bounded by the calendar, not by the raw row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_time(keys: Sequence[str], date: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date)


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def spread(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Hash partitions by the keys, by default as many as spark.sql.shuffle.partitions, for work that is heavy per byte:
    adaptive execution would merge such partitions by their small size. A later grouping or window on the keys needs no
    further shuffle."""
    if not keys:
        return df
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_position(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Adds `__row` (1-based, oldest first) and `__rows` (rows of the key)."""
    return df.withColumns({"__row": F.row_number().over(by_time(keys, date)), "__rows": F.count(F.lit(1)).over(whole(keys))})


def with_step(df: DataFrame, keys: Sequence[str], horizon: int, date: str = "date") -> DataFrame:
    """Adds `__row`, `__rows` and `step`: 0..horizon-1 on the newest `horizon` rows (oldest first), NULL before them.

    A row needs history, so the first row of a key is never a backtest origin.
    """
    df = with_position(df, keys, date)
    step = F.col("__row") - F.col("__rows") + horizon - 1
    return df.withColumn("step", F.when((step >= 0) & (F.col("__row") > 1), step.cast("int")))


def tail(df: DataFrame, keys: Sequence[str], rows: int, date: str = "date") -> DataFrame:
    """Newest `rows` rows of every key."""
    last = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return df.withColumn("__back", F.row_number().over(last)).filter(F.col("__back") <= rows).drop("__back")


def head(df: DataFrame, keys: Sequence[str], rows: int, date: str = "date") -> DataFrame:
    """Oldest `rows` rows of every key."""
    return df.withColumn("__at", F.row_number().over(by_time(keys, date))).filter(F.col("__at") <= rows).drop("__at")


def row_at(df: DataFrame, keys: Sequence[str], back: int, date: str = "date") -> DataFrame:
    """The single row `back` places before the newest one (0 = newest)."""
    last = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return df.withColumn("__back", F.row_number().over(last)).filter(F.col("__back") == back + 1).drop("__back")


def zip_by_step(left: DataFrame, right: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Two equally long tables side by side: an equi join on the keys and the step number."""
    return join_keys(left, right, [*keys, step])


def join_keys(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, which appear once. A NULL key is a key like any other, as in grouping and windows."""
    theirs = {c: f"__right_{c}" for c in on}
    renamed = right.withColumnsRenamed(theirs)
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(renamed[theirs[c]])
    return left.join(renamed, cond, how).drop(*theirs.values())


def off_level(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`cols` as doubles less their mean over the key, and `__level_<column>` with that mean (0 where nothing is known).

    Sums of squares lose the digits that a common level takes up; regressions with an intercept don't need the level.
    """
    out = df.withColumns({f"__level_{c}": F.coalesce(F.avg(F.col(c).cast("double")).over(whole(keys)), F.lit(0.0)) for c in cols})
    return out.withColumns({c: F.col(c).cast("double") - F.col(f"__level_{c}") for c in cols})


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-key table onto rows; without keys `right` is a single aggregate row, so broadcasting it is safe."""
    if keys:
        return join_keys(left, right, list(keys), how)
    return left.join(F.broadcast(right), how="cross")


def assert_unique(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Fails at run time when a (keys, date) pair occurs twice; the check rides on the existing key partitioning."""
    dup = F.count(F.lit(1)).over(Window.partitionBy(*keys, date))
    return df.withColumn("__n", dup).filter(
        F.when(F.col("__n") > 1, F.raise_error(F.lit("series has duplicate dates"))).otherwise(F.lit(True))
    ).drop("__n")
