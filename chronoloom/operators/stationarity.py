"""Unit-root test, the choice of differencing level, and the autoregressive order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.columns import unit_root_p_value
from chronoloom.operators.frame import by_time, off_level
from chronoloom.operators.gram import (
    KeyMoments,
    centred,
    cross_products,
    gaussian_criterion,
    least_squares,
    residual_sum,
    solve_per_key,
    varying_columns,
)


def default_test_lags(rows: int) -> int:
    """Largest lag of the unit-root test: ceil(12 * (rows / 100)^(1/4)), at most rows//2 - 2."""
    return max(min(int(np.ceil(12.0 * (rows / 100.0) ** 0.25)), rows // 2 - 2), 0)


def longest_series(df: DataFrame, keys: Sequence[str] = ()) -> int:
    """Rows of the longest series: one aggregated number."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return int(per_key.agg(F.max("n")).first()[0] or 0)


def _fit_full(gram, xs):
    used = varying_columns(gram, xs)
    n, mx, my, sxx, sxy, _ = centred(gram, used)
    beta = least_squares(sxx, sxy)
    return n, used, beta, my - mx @ beta, sxx


def _unit_root(max_lag: int, fixed_lag: int | None):
    """z = [1, dy, y_lag1, dy_lag1..dy_lagL]; the first L usable rows arrive as single rows."""

    def run(m: KeyMoments) -> pd.DataFrame:
        core = m.total()
        rows = int(core[0, 0]) + len(m.steps) if m.width else 0  # differenced rows
        nobs = rows + 1
        cap = min(max_lag, default_test_lags(nobs)) if fixed_lag is None else fixed_lag
        stat, lag = np.nan, None
        if rows > 3 and m.width and rows > 2 * cap + 3:
            def over(start: int, lags: int) -> np.ndarray:
                width = 3 + lags
                g = core[:width, :width].copy()
                for i in np.flatnonzero(m.steps >= start):
                    z = m.rows[i][:width]
                    if np.isfinite(z).all():
                        g += np.outer(z, z)
                return g

            lag = cap
            if fixed_lag is None:
                scores = []
                for k in range(cap + 1):
                    g = over(cap, cap)[: 3 + k, : 3 + k]
                    n, used, beta, b0, _ = _fit_full(g, list(range(2, 3 + k)))
                    scores.append(gaussian_criterion(residual_sum(g, b0, beta, used), n, k + 2))
                lag = int(np.argmin(scores))
            g = over(lag, lag)
            n, used, beta, b0, sxx = _fit_full(g, list(range(2, 3 + lag)))
            dof = n - lag - 2
            if dof > 0 and used and used[0] == 2:
                s2 = residual_sum(g, b0, beta, used) / dof
                d = np.sqrt(np.diag(sxx))
                inv = np.linalg.pinv(sxx / np.outer(d, d), hermitian=True)
                se = np.sqrt(max(s2 * inv[0, 0], 0.0)) / d[0]
                stat = beta[0] / se if se > 0 else np.nan
        return pd.DataFrame(
            [(None if not np.isfinite(stat) else float(stat), None if lag is None else int(lag), nobs)],
            columns=["stat", "used_lag", "nobs"],
        )

    return run


def unit_root_test(
    df: DataFrame,
    var: str,
    *,
    keys: Sequence[str] = (),
    date: str = "date",
    max_lag: int | None = None,
    fixed_lag: int | None = None,
) -> DataFrame:
    """(keys, stat, used_lag, nobs, p_value): augmented Dickey-Fuller test with a constant, lag length by AIC.

    A series too short or too degenerate to test gets p_value 1. `max_lag` bounds the lag columns; by default it
    follows from the longest series.
    """
    base = df.select(*keys, date, F.col(var).cast("double").alias("y")).dropna(subset=["y"])
    if fixed_lag is not None:
        top = fixed_lag
    else:
        top = default_test_lags(longest_series(base, keys)) if max_lag is None else max_lag
    base = off_level(base, ["y"], keys)
    w = by_time(keys, date)
    base = base.withColumns(
        {"__d": F.col("y") - F.lag("y", 1).over(w), "__y1": F.lag("y", 1).over(w), "__rn": F.row_number().over(w) - 2}
    )
    lags = {f"__d{i}": F.lag("__d", i).over(w) for i in range(1, top + 1)}
    base = base.withColumns(lags).filter(F.col("__rn") >= 0)
    step = F.when(F.col("__rn") < top, F.col("__rn").cast("int"))
    parts = cross_products(base, [F.lit(1.0), "__d", "__y1", *lags], keys=keys, date=date, step=step)
    out = solve_per_key(parts, keys, _unit_root(top, fixed_lag), "stat double, used_lag int, nobs long", carried=0)
    return out.withColumn("p_value", unit_root_p_value(F.col("stat")))


def choose_difference(
    df: DataFrame,
    target: str,
    *,
    keys: Sequence[str] = (),
    date: str = "date",
    max_order: int = 2,
    level: float = 0.05,
    max_lag: int | None = None,
) -> DataFrame:
    """(keys, diff_order, p_level, p_first, p_second): 0 if the level is stationary, else 1, else 2, else 0.

    `df` holds `target` and, up to `max_order`, `difference` and `secdifference`.
    """
    columns = [target, "difference", "secdifference"][: max_order + 1]
    stacked = df.unpivot([*keys, date], [F.col(c).cast("double").alias(c) for c in columns], "series", "value")
    p = unit_root_test(stacked, "value", keys=[*keys, "series"], date=date, max_lag=max_lag)
    wide = p.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when(F.col("series") == c, F.col("p_value"))), F.lit(1.0)).alias(name)
            for c, name in zip([target, "difference", "secdifference"], ["p_level", "p_first", "p_second"])
        ]
    )
    order = (
        F.when(F.col("p_level") < level, F.lit(0))
        .when(F.col("p_first") < level, F.lit(1))
        .when(F.col("p_second") < level, F.lit(2))
        .otherwise(F.lit(0))
    )
    return wide.withColumn("diff_order", order)


def drop_leading(
    df: DataFrame,
    order: str,
    *,
    keys: Sequence[str] = (),
    date: str = "date",
    shifted: bool = False,
) -> DataFrame:
    """Drops as many leading rows as the differencing order took values, one at least if columns were shifted."""
    gone = F.greatest(F.col(order), F.lit(1 if shifted else 0))
    return df.withColumn("__rn", F.row_number().over(by_time(keys, date))).filter(F.col("__rn") > gone).drop("__rn")


def _orders(max_lags: int, criterion: str):
    """z = [1, y, y_lag1..y_lagL]; the first L rows arrive as single rows, so every order can use its own sample."""

    def run(m: KeyMoments) -> pd.DataFrame:
        out = []
        if m.width:
            core = m.total()
            for p in range(1, max_lags + 1):
                g = core[: 2 + p, : 2 + p].copy()
                for i in range(len(m.steps)):
                    z = m.rows[i][: 2 + p]
                    if m.steps[i] >= p and np.isfinite(z).all():
                        g += np.outer(z, z)
                n = g[0, 0]
                if n < p + 3:
                    break
                _, used, beta, b0, _ = _fit_full(g, list(range(2, 2 + p)))
                out.append((p, gaussian_criterion(residual_sum(g, b0, beta, used), n, p + 2, criterion), int(n)))
        return pd.DataFrame(out, columns=["lags", "score", "nobs"])

    return run


def lag_order_scores(
    df: DataFrame, var: str, max_lags: int, *, criterion: str = "AIC", keys: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """(keys, lags, score, nobs) for every workable autoregressive order. Order p uses all rows after the p-th."""
    w = by_time(keys, date)
    base = off_level(df.select(*keys, date, F.col(var).cast("double").alias("y")).dropna(subset=["y"]), ["y"], keys)
    lags = {f"__l{i}": F.lag("y", i).over(w) for i in range(1, max_lags + 1)}
    base = base.withColumns({**lags, "__rn": F.row_number().over(w) - 1})
    step = F.when(F.col("__rn") < max_lags, F.col("__rn").cast("int"))
    parts = cross_products(base, [F.lit(1.0), "y", *lags], keys=keys, date=date, step=step)
    return solve_per_key(parts, keys, _orders(max_lags, criterion), "lags int, score double, nobs long", carried=0)


def choose_lag_order(
    df: DataFrame, var: str, max_lags: int, *, criterion: str = "AIC", keys: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """(keys, lag_order): the order with the lowest score. A key for which no order could be fitted has no row; its
    order is 1."""
    scores = lag_order_scores(df, var, max_lags, criterion=criterion, keys=keys, date=date)
    best = scores.groupBy(*keys).agg(F.min_by("lags", F.struct("score", "lags")).alias("lag_order"))
    return best if keys else best.select(F.coalesce("lag_order", F.lit(1)).alias("lag_order"))
