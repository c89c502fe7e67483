"""Positional transforms of a series: shifts, differences, lags, edge cuts, long/wide reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.frame import by_time, with_position


def divide_columns(df: DataFrame, cols: Sequence[str], by: float) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c), F.lit(float(by))) for c in cols}) if cols else df


def shift_columns(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), date: str = "date", by: int = 1
) -> DataFrame:
    """Moves exogenous columns `by` rows later, so a row only carries what was known before it."""
    w = by_time(keys, date)
    return df.withColumns({c: F.lag(c, by).over(w) for c in cols}) if cols else df


def cut_extremes(
    df: DataFrame, keys: Sequence[str] = (), date: str = "date", first: int = 1, last: int = 1
) -> DataFrame:
    """Drops the first and last buckets of every key (usually only partly covered by data)."""
    placed = with_position(df, keys, date)
    return placed.filter((F.col("__row") > first) & (F.col("__row") <= F.col("__rows") - last)).drop("__row", "__rows")


def difference(
    df: DataFrame, var: str, keys: Sequence[str] = (), date: str = "date", name: str = "difference"
) -> DataFrame:
    return df.withColumn(name, F.col(var) - F.lag(var).over(by_time(keys, date)))


def differences(df: DataFrame, var: str, keys: Sequence[str] = (), date: str = "date", order: int = 2) -> DataFrame:
    """`difference` and, for order 2, `secdifference`, from one window (second = y - 2*lag1 + lag2)."""
    w = by_time(keys, date)
    new = {}
    if order >= 1:
        new["difference"] = F.col(var) - F.lag(var, 1).over(w)
    if order >= 2:
        new["secdifference"] = (F.col(var) - F.lag(var, 1).over(w)) - (F.lag(var, 1).over(w) - F.lag(var, 2).over(w))
    return df.withColumns(new) if new else df


def lag_columns(
    variables: Sequence[str], n: int, keys: Sequence[str] = (), date: str = "date"
) -> dict[str, Column]:
    w = by_time(keys, date)
    return {f"lag_{v}_{i}": F.lag(F.col(v).cast("double"), i).over(w) for v in variables for i in range(1, n + 1)}


def lag_block(
    df: DataFrame, variables: Sequence[str], n: int, keys: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """`lag_{var}_1..n` for every variable, all from one window."""
    return df.withColumns(lag_columns(variables, n, keys, date))


def lag_block_by_order(
    df: DataFrame,
    variables: Sequence[str],
    max_order: int,
    order_col: str,
    keys: Sequence[str] = (),
    date: str = "date",
) -> DataFrame:
    """Lag block whose length differs per key: lags beyond the key's own order are the constant 0, which every
    model drops as a constant column."""
    new = {}
    for name, lagged in lag_columns(variables, max_order, keys, date).items():
        i = int(name.rsplit("_", 1)[1])
        new[name] = F.when(F.col(order_col) >= i, lagged).otherwise(F.lit(0.0))
    return df.withColumns(new)


def to_long(df: DataFrame, ids: Sequence[str], value_columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(value_columns), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str] | None = None
) -> DataFrame:
    """One column per `name`; pass `names` to save the job that finds them."""
    grouped = df.groupBy(*ids)
    pivoted = grouped.pivot(name, list(names)) if names else grouped.pivot(name)
    return pivoted.agg(F.first(value, ignorenulls=True))


def stack_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def unbounded_before(keys: Sequence[str], date: str = "date"):
    """Frame of every row strictly before the current one."""
    return by_time(keys, date).rowsBetween(Window.unboundedPreceding, -1)
