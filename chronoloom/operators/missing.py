"""Missing-value repair, per key. Every method is a window or a projection; none adds a shuffle to a keyed series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoloom.operators.frame import by_time, numeric_columns, whole

# Configuration names of the repair methods and what each of them does.
METHOD_NAMES = {
    "": "drop",
    "drop": "drop",
    "substitute_by_value": "value",
    "substitute_by_mean": "mean",
    "substitute_by_median": "median",
    "substitute_backward": "ffill",
    "substitute_forward": "bfill",
    "substitute_interpolate": "interpolate",
}


def carried_forward(c: str, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def taken_backward(c: str, w: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def fill_value(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    """Constant fill; a value that cannot stand in for a number counts as 0."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = 0.0
    return df.fillna(number, subset=list(cols))


def fill_mean(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    w = whole(keys)
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in cols})


def fill_median(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    w = whole(keys)
    return df.withColumns({c: F.coalesce(F.col(c), F.percentile(c, F.lit(0.5)).over(w)) for c in cols})


def fill_forward(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    w = by_time(keys, date)
    return df.withColumns({c: carried_forward(c, w) for c in cols})


def fill_backward(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    w = by_time(keys, date)
    return df.withColumns({c: taken_backward(c, w) for c in cols})


def interpolate(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Linear by row position. Leading nulls stay; trailing nulls repeat the last value."""
    w = by_time(keys, date)
    df = df.withColumn("__rn", F.row_number().over(w))
    marks = {f"__at_{c}": F.when(F.col(c).isNotNull(), F.col("__rn")) for c in cols}
    df = df.withColumns(marks)
    ends = {}
    for c in cols:
        ends[f"__pv_{c}"] = carried_forward(c, w)
        ends[f"__pr_{c}"] = carried_forward(f"__at_{c}", w)
        ends[f"__nv_{c}"] = taken_backward(c, w)
        ends[f"__nr_{c}"] = taken_backward(f"__at_{c}", w)
    df = df.withColumns(ends)
    out = {}
    for c in cols:
        pv, pr, nv, nr = (F.col(f"__{part}_{c}") for part in ("pv", "pr", "nv", "nr"))
        line = pv + (nv - pv) * (F.col("__rn") - pr) / (nr - pr)
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(nv.isNull(), pv).otherwise(line)
    return df.withColumns(out).drop("__rn", *marks, *ends)


def repair(
    df: DataFrame,
    method: str,
    *,
    keys: Sequence[str] = (),
    date: str = "date",
    cols: Sequence[str] | None = None,
    value=None,
) -> DataFrame:
    """Drops rows without a date, then applies one method by its configuration name or its short name."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[*keys, date])
    df = df.dropna(subset=[date])
    kind = METHOD_NAMES.get(method or "", method)
    if kind == "value":
        return fill_value(df, cols, value).dropna()
    if kind == "mean":
        return fill_mean(df, cols, keys).dropna()
    if kind == "median":
        return fill_median(df, cols, keys).dropna()
    if kind == "ffill":
        return fill_forward(df, cols, keys, date)
    if kind == "bfill":
        return fill_backward(df, cols, keys, date)
    if kind == "interpolate":
        return interpolate(df, cols, keys, date)
    return df.dropna()
