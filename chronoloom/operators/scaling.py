"""Fit, apply and invert the three normalisations. Fitted values live in a small per-key table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from chronoloom.operators.frame import attach, whole

# Configuration names; any other name means min-max.
METHODS = {"z_score": "z", "robust_scaler": "robust", "z": "z", "robust": "robust"}


def method_of(name: str | None) -> str:
    return METHODS.get(name or "", "minmax")


def _parameters(c: str, method: str, keep: Column | None, w: WindowSpec | None = None) -> tuple[Column, Column]:
    """(location, scale) of one column, as aggregates or over a window."""
    v = F.col(c) if keep is None else F.when(keep, F.col(c))

    def over(agg: Column) -> Column:
        return agg if w is None else agg.over(w)

    if method == "z":
        return over(F.avg(v)), over(F.stddev_pop(v))
    if method == "robust":
        q = over(F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
        return q[1], q[2] - q[0]
    return over(F.min(v)), over(F.max(v)) - over(F.min(v))


def fit_scaler(
    df: DataFrame, cols: Sequence[str], method: str, keys: Sequence[str] = (), keep: Column | None = None
) -> DataFrame:
    """One row per key with `{col}__loc` and `{col}__scale`. `keep` limits the fit, e.g. to training rows."""
    kind = method_of(method)
    aggs = []
    for c in cols:
        loc, scale = _parameters(c, kind, keep)
        aggs += [loc.cast("double").alias(f"{c}__loc"), scale.cast("double").alias(f"{c}__scale")]
    return df.groupBy(*keys).agg(*aggs)


def scale_series(
    df: DataFrame, cols: Sequence[str], method: str, keys: Sequence[str] = (), keep: Column | None = None
) -> DataFrame:
    """Fit and apply in one go for a series: the parameters are window values over the key, so the input is read
    once and nothing is joined. They stay on the rows as `{col}__loc` and `{col}__scale`."""
    kind, w = method_of(method), whole(keys)
    fitted: dict[str, Column] = {}
    for c in cols:
        loc, scale = _parameters(c, kind, keep, w)
        fitted |= {f"{c}__loc": loc.cast("double"), f"{c}__scale": scale.cast("double")}
    df = df.withColumns(fitted)
    return df.withColumns({c: F.try_divide(F.col(c) - F.col(f"{c}__loc"), F.col(f"{c}__scale")) for c in cols})


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(x - loc) / scale; a scale of 0 gives NULL."""
    joined = attach(df, stats, keys, "left")
    new = {c: F.try_divide(F.col(c) - F.col(f"{c}__loc"), F.col(f"{c}__scale")) for c in cols}
    return joined.withColumns(new).select(*df.columns)


def invert_scaler(
    df: DataFrame, stats: DataFrame, fitted: str, cols: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Maps `cols` (predictions, say) back with the parameters fitted on column `fitted`."""
    pair = stats.select(*keys, f"{fitted}__loc", f"{fitted}__scale")
    joined = attach(df, pair, keys, "left")
    new = {c: F.col(c) * F.col(f"{fitted}__scale") + F.col(f"{fitted}__loc") for c in cols}
    return joined.withColumns(new).select(*df.columns)


def stats_long(stats: DataFrame, cols: Sequence[str], method: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, method, p1, p2): for min-max p1/p2 are min and max, else location and scale."""
    kind = method_of(method)
    parts = []
    for c in cols:
        loc, scale = F.col(f"{c}__loc"), F.col(f"{c}__scale")
        p2 = loc + scale if kind == "minmax" else scale
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("method"), loc.alias("p1"), p2.alias("p2")))
    return stats.select(*keys, F.explode(F.array(*parts)).alias("s")).select(*keys, "s.*")
