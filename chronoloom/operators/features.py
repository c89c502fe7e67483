"""Engineered features: trailing statistics, calendar parts and the feature-list rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.frame import by_time, numeric_columns

Span = tuple[str, int, int]


def _frame(a: int, b: int, keys: Sequence[str], date: str):
    """Rows i-b .. i-a-1: the window ends `a` rows short of the previous row."""
    if b <= a:
        raise ValueError(f"empty trailing frame ({a}, {b})")
    return by_time(keys, date).rowsBetween(-b, -(a + 1))


def trailing_mean(var: str, a: int, b: int, keys: Sequence[str] = (), date: str = "date") -> Column:
    return F.avg(var).over(_frame(a, b, keys, date))


def trailing_median(var: str, a: int, b: int, keys: Sequence[str] = (), date: str = "date") -> Column:
    return F.percentile(var, F.lit(0.5)).over(_frame(a, b, keys, date))


def trailing_weighted_mean(
    var: str, a: int, b: int, keys: Sequence[str] = (), date: str = "date", position: str = "__pos"
) -> Column:
    """Linear weights 1..m, newest heaviest; NULL when the frame is empty or holds a NULL. Needs `position`."""
    w = _frame(a, b, keys, date)
    m = F.count(F.lit(1)).over(w)
    ramp = F.sum(F.col(var) * F.col(position)).over(w) - (F.min(position).over(w) - 1) * F.sum(var).over(w)
    return F.when((m > 0) & (F.count(var).over(w) == m), ramp / (m * (m + 1) / 2))


def add_trailing(
    df: DataFrame,
    *,
    means: Sequence[Span] = (),
    medians: Sequence[Span] = (),
    weighted: Sequence[Span] = (),
    keys: Sequence[str] = (),
    date: str = "date",
) -> DataFrame:
    """All trailing features in one projection, so they share one sort and one shuffle."""
    if weighted:
        df = df.withColumn("__pos", F.row_number().over(by_time(keys, date)))
    new = {f"mean_{v}_{a}_{b}": trailing_mean(v, int(a), int(b), keys, date) for v, a, b in means}
    new |= {f"mean_weighted_{v}_{a}_{b}": trailing_weighted_mean(v, int(a), int(b), keys, date) for v, a, b in weighted}
    new |= {f"median_{v}_{a}_{b}": trailing_median(v, int(a), int(b), keys, date) for v, a, b in medians}
    return df.withColumns(new).drop("__pos") if new else df


def add_calendar_parts(df: DataFrame, level: str, date: str = "date") -> DataFrame:
    """`Year` plus `Week` / `Month` / `Month`,`Day`. A January date in ISO week 52 or 53 counts as week 0."""
    d = F.col(date)
    parts: dict[str, Column] = {"Year": F.year(d)}
    if level == "weekly":
        week = F.weekofyear(d)
        parts["Week"] = F.when((week >= 52) & (F.month(d) == 1), F.lit(0)).otherwise(week)
    elif level == "monthly":
        parts["Month"] = F.month(d)
    elif level == "daily":
        parts["Month"] = F.month(d)
        parts["Day"] = F.dayofmonth(d)
    return df.withColumns(parts)


def feature_columns(
    df: DataFrame,
    *,
    target: str,
    keys: Sequence[str] = (),
    date: str = "date",
    lags: bool = True,
    engineered: bool = True,
    helpers: Sequence[str] = ("lag_order",),
) -> list[str]:
    """Numeric columns a model may use: never the keys, date, target or its differences.

    Constant columns are not decided here: whether a column is constant depends on the origin, so the models drop
    them per key and origin.
    """
    banned = {*keys, date, target, "difference", "secdifference", *helpers}
    names = numeric_columns(df, exclude=list(banned))
    if not lags:
        names = [c for c in names if "lag" not in c]
    if not engineered:
        made = ("mean_", "median_")
        dates = {"Year", "Month", "Week", "Day"}
        names = [c for c in names if not c.startswith(made) and c not in dates]
    return names


def constant_columns(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, is_constant): at most one distinct non-null value, told by min = max in one pass."""
    flags = df.groupBy(*keys).agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in cols])
    return flags.unpivot(list(keys), list(cols), "column", "is_constant")
