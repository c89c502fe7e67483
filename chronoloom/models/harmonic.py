"""Multi-seasonal forecasts by harmonic regression: sine and cosine pairs per period, a trend and recent values.

Stands in for a trigonometric state-space model; estimates come from cross products, and the number of harmonics
is chosen by an information criterion at every origin.

`power_harmonic_forecasts` adds what such a model has besides: a power transform by profile likelihood and ARMA errors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.models.arima import arima_forecasts
from chronoloom.operators.frame import attach, by_time, join_keys, off_level, whole, with_step
from chronoloom.operators.gram import KeyMoments, cross_products, fit, gaussian_criterion, residual_sum, solve_per_key
from chronoloom.session import cut_lineage

# The powers tried, the plain series first, so that it wins ties.
POWERS = tuple(i / 20 for i in range(20, -1, -1))


def fourier(position: Column, period: float, order: int, tag: str) -> dict[str, Column]:
    """`order` sine/cosine pairs of one period."""
    out = {}
    for k in range(1, order + 1):
        angle = position * (2 * np.pi * k / period)
        out[f"__s_{tag}_{k}"] = F.sin(angle)
        out[f"__c_{tag}_{k}"] = F.cos(angle)
    return out


def _harmonics(levels: list[list[int]], always: list[int], lags: list[int], exponential: bool, name: str):
    def run(m: KeyMoments) -> pd.DataFrame:
        out = []
        gram = m.total() if m.width else None
        for i, step in enumerate(m.steps):
            z, best = m.rows[i], None
            for harmonics in levels:
                for memory in (lags, []):
                    xs = always + harmonics + memory
                    if gram[0, 0] <= len(xs) + 2 or not np.isfinite(z[xs]).all():
                        continue
                    b0, beta, used = fit(gram, xs)
                    score = gaussian_criterion(residual_sum(gram, b0, beta, used), gram[0, 0], len(used) + 2)
                    if best is None or score < best[0]:
                        best = (score, z[-1] + b0 + (z[used] @ beta if used else 0.0))
            pred = None
            if best and np.isfinite(best[1]):
                pred = float(np.exp(best[1])) if exponential else float(best[1])
            out.append((int(step), m.dates[i], name, pred))
            if m.complete(i):
                gram = gram + np.outer(z, z)
        return pd.DataFrame(out, columns=["step", "date", "model", "pred"])

    return run


def harmonic_forecasts(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    periods: Sequence[float] = (7, 30),
    keys: Sequence[str] = (),
    date: str = "date",
    max_order: int = 3,
    memory: int = 2,
    log: bool = False,
    name: str = "tbats",
) -> DataFrame:
    """`memory` recent values carry the short-run dynamics; `log` models the logarithm of a positive series."""
    y = F.col(target).cast("double")
    base = df.select(*keys, date, (F.when(y > 0, F.log(y)) if log else y).alias("y"))
    base = off_level(with_step(base, keys, horizon, date), ["y"], keys)
    w = by_time(keys, date)
    cols: dict[str, Column] = {"__t": F.col("__row") / F.col("__rows")}
    groups: list[dict[str, Column]] = []
    for j, period in enumerate(periods):
        groups.append(fourier(F.col("__row"), float(period), min(max_order, int(period // 2)), f"p{j}"))
        cols |= groups[-1]
    lags = {f"__l{i}": F.lag("y", i).over(w) for i in range(1, memory + 1)}
    cols |= lags
    base = base.withColumns(cols)
    names = ["__t", *[c for g in groups for c in g], *lags]
    at = {c: i + 2 for i, c in enumerate(names)}
    levels = []
    for order in range(0, max_order + 1):
        levels.append([at[c] for g in groups for c in g if int(c.rsplit("_", 1)[1]) <= order])
    parts = cross_products(base, [F.lit(1.0), "y", *names, "__level_y"], keys=keys, date=date, step="step")
    run = _harmonics(levels, [at["__t"]], [at[c] for c in lags], log, name)
    return solve_per_key(parts, keys, run, "step int, date date, model string, pred double", carried=1)


def raised(u: Column, power: Column) -> Column:
    """The power transform (u^power - 1) / power, at 0 the logarithm. NULL for what isn't above 0, unless the power is 1."""
    above = F.when(u > 0, u)
    return F.when(power == 1, u - 1).when(power == 0, F.log(above)).otherwise((F.pow(above, power) - 1) / power)


def lowered(z: Column, power: Column) -> Column:
    """What `raised` came from; 0 where no value above 0 has that transform."""
    return F.when(power == 1, z + 1).when(power == 0, F.exp(z)).otherwise(F.pow(F.greatest(power * z + 1, F.lit(0.0)), 1 / power))


def _profile(powers: Sequence[float], levels: list[list[int]], first: int):
    """The power and the number of harmonics of least criterion. Targets are the columns from `first` on, the last column
    says whether powers may be used."""

    def run(m: KeyMoments) -> pd.DataFrame:
        best = None
        gram = m.total() if m.width else np.zeros((1, 1))
        rows = gram[0, 0]
        for i, power in enumerate(powers):
            if not rows or (power != 1 and gram[0, -1] < rows):
                continue
            for order, xs in enumerate(levels):
                if rows <= len(xs) + 3:
                    continue
                own = [0, first + i, *xs]
                part = gram[np.ix_(own, own)]
                b0, beta, used = fit(part, list(range(2, len(own))))
                score = gaussian_criterion(residual_sum(part, b0, beta, used), rows, len(used) + 3)
                if best is None or score < best[0]:
                    at = [own[u] for u in used]
                    coef = m.plain(b0 + m.shift[first + i], beta, at)
                    best = (score, float(power), order, coef[:first].tolist())
        return pd.DataFrame([best[1:]] if best else [], columns=["power", "harmonics", "coef"])

    return run


def _powered(df, target, horizon, periods, keys, date, max_order) -> tuple[DataFrame, list[str], list[list[int]]]:
    """Rows with step, `__y`, `__scale`, `__able` and the regressors; their names; the columns of each number of harmonics."""
    base = with_step(df.select(*keys, date, F.col(target).cast("double").alias("__y")), keys, horizon, date)
    w0, early = whole(keys), F.when(F.col("step").isNull(), F.col("__y"))
    able = F.coalesce(F.min(early).over(w0) > 0, F.lit(False))
    # of unit geometric mean the transforms of all powers have the same Jacobian, so their errors compare as they are
    geometric = F.exp(F.avg(F.when(early > 0, F.log(early))).over(w0))
    base = base.withColumns({"__able": able, "__scale": F.when(able, geometric).otherwise(F.lit(1.0))})
    cols: dict[str, Column] = {"__t": F.col("__row") / F.col("__rows")}
    for j, period in enumerate(periods):
        cols |= fourier(F.col("__row"), float(period), min(max_order, int(period // 2)), f"p{j}")
    names = list(cols)
    levels = [[i + 2 for i, c in enumerate(names) if c == "__t" or int(c.rsplit("_", 1)[1]) <= order] for order in range(max_order + 1)]
    return base.withColumns(cols), names, levels


def _chosen(base: DataFrame, names, levels, keys, date, powers) -> DataFrame:
    u = F.col("__y") / F.col("__scale")
    targets = [F.when(F.col("__able"), raised(u, F.lit(float(p)))).otherwise(u - 1) for p in powers]
    row = [F.lit(1.0), F.lit(0.0), *names, *targets, F.col("__able").cast("double")]
    parts = cross_products(base.filter(F.col("step").isNull()), row, keys=keys, date=date)
    return solve_per_key(parts, keys, _profile(powers, levels, 2 + len(names)), "power double, harmonics int, coef array<double>", carried=1)


def power_choice(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    periods: Sequence[float] = (7, 30),
    keys: Sequence[str] = (),
    date: str = "date",
    max_order: int = 3,
    powers: Sequence[float] = POWERS,
) -> DataFrame:
    """(keys, power, harmonics, coef): what the likelihood of the rows before the first origin says, trend and harmonics profiled out.

    One pass of cross products serves all powers. A key with a value that isn't above 0 among these rows keeps its scale
    (power 1); a key with too few rows for a trend has no row here.
    """
    base, names, levels = _powered(df, target, horizon, periods, keys, date, max_order)
    return _chosen(base, names, levels, keys, date, powers)


def power_harmonic_forecasts(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    periods: Sequence[float] = (7, 30),
    keys: Sequence[str] = (),
    date: str = "date",
    max_order: int = 3,
    powers: Sequence[float] = POWERS,
    max_p: int = 2,
    max_q: int = 2,
    name: str = "tbats",
) -> DataFrame:
    """Power transform, trend and harmonics as `power_choice` finds them; what they leave is an ARMA series by conditional likelihood.

    Trend, harmonics and power come from the rows before the first origin and stay; the errors are estimated on at every
    origin. Keys too short for ARMA errors are forecast without them, keys without a choice get NULL.
    """
    keys = list(keys)
    base, names, levels = _powered(df, target, horizon, periods, keys, date, max_order)
    base = cut_lineage(base)
    base = attach(base, _chosen(base, names, levels, keys, date, powers), keys, "left")
    row = F.array(F.lit(1.0), F.lit(0.0), *[F.col(c) for c in names])
    mean = F.aggregate(F.zip_with(row, "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    base = base.withColumn("__mean", mean)
    base = base.withColumn("__left", raised(F.col("__y") / F.col("__scale"), F.col("power")) - F.col("__mean"))
    base = cut_lineage(base.select(*keys, F.col(date).alias("date"), "step", "__mean", "__left", "__scale", "power"))
    errors = arima_forecasts(
        base.drop("step"), target="__left", horizon=horizon, keys=keys, d=0, max_p=max_p, max_q=max_q, method="likelihood", stored=True)
    errors = errors.select(*keys, "date", F.col("pred").alias("__error"))
    out = join_keys(base.filter(F.col("step").isNotNull()), errors, [*keys, "date"], "left")
    value = F.col("__scale") * lowered(F.col("__mean") + F.coalesce("__error", F.lit(0.0)), F.col("power"))
    return out.select(*keys, "step", "date", F.lit(name).alias("model"), value.alias("pred"))
