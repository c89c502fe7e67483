"""Trend + season + holiday regression after Taylor and Letham (2018), as penalised least squares on cross products.

Trend is piecewise linear with hinges over the first 80% of the training span; seasons are Fourier columns; holidays
mark the day and the day after. Prior scales become penalties: absolute values for hinges (`changepoint_prior` "normal" asks
for squares), squares for the rest. Multiplicative season models the logarithm,
logistic growth the logit against a cap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.models.linear import sparse_fit
from chronoloom.operators.frame import join_keys, whole, with_step
from chronoloom.operators.gram import KeyMoments, centred, cross_products, fit, residual_sum, solve_per_key, varying_columns
from chronoloom.session import cut_lineage

# Season lengths in days and their Fourier orders; hinge count and the share of history they cover.
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8


@dataclass(frozen=True)
class AdditiveParams:
    growth: str = "linear"
    yearly_seasonality: bool = False
    weekly_seasonality: bool = True
    daily_seasonality: bool = False
    seasonality_mode: str = "additive"
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    holidays_prior_scale: float = 10.0
    changepoint_prior: str = "laplace"
    cap: float | None = None

    @property
    def transform(self) -> str:
        if self.growth == "logistic":
            return "logit"
        return "log" if self.seasonality_mode == "multiplicative" else "none"


def params_grid(grid: Mapping[str, Sequence], base: AdditiveParams = AdditiveParams()) -> list[AdditiveParams]:
    """Every combination of the listed settings."""
    known = {k: v for k, v in grid.items() if k in AdditiveParams.__dataclass_fields__}
    return [replace(base, **dict(zip(known, values))) for values in product(*known.values())]


def _design(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    keys: Sequence[str],
    date: str,
    holidays: DataFrame | None,
    exogenous: Sequence[str],
    changepoints: int,
) -> tuple[DataFrame, dict[str, int]]:
    """Rows with one design array per role (trend, hinge, seasons, holiday, exogenous), and the width of each."""
    base = df.select(*keys, date, F.col(target).cast("double").alias("__y"), *exogenous)
    base = with_step(base, keys, horizon, date)
    w0 = whole(keys)
    core = F.col("step").isNull()
    base = base.withColumns(
        {
            "__first": F.min(date).over(w0),
            "__last": F.max(F.when(core, F.col(date))).over(w0),
            "__top": F.max(F.when(core, F.col("__y"))).over(w0),
            "__size": F.max(F.when(core, F.abs("__y"))).over(w0),
        }
    )
    t = F.coalesce(
        F.try_divide(F.datediff(date, "__first").cast("double"), F.datediff("__last", "__first")), F.lit(0.0)
    )
    base = base.withColumn("__t", t)
    day = F.unix_date(F.to_date(date)).cast("double")
    # designs are array columns: dozens of scalar columns would outgrow the generated code
    starts = F.array(*[F.lit(CHANGEPOINT_RANGE * j / changepoints) for j in range(1, changepoints + 1)])
    arrays: dict[str, Column] = {
        "trend": F.array("__t"),
        "hinge": F.transform(starts, lambda c: F.greatest(F.col("__t") - c, F.lit(0.0))),
    }
    widths = {"trend": 1, "hinge": changepoints}
    for season, (period, order) in SEASONS.items():
        arrays[season] = fourier_array(day, period, order)
        widths[season] = 2 * order
    if holidays is not None:
        # distinct holiday dates: bounded by the calendar, whatever the series size, so broadcasting is safe
        days = holidays.select(F.to_date("date").alias("__hd")).distinct()
        for shift in (0, 1):
            marks = days.select(F.date_add("__hd", shift).alias(date), F.lit(1.0).alias(f"__hol{shift}"))
            base = base.join(F.broadcast(marks), date, "left")
        arrays["holiday"] = F.array(*[F.coalesce(f"__hol{shift}", F.lit(0.0)) for shift in (0, 1)])
        widths["holiday"] = 2
    if exogenous:
        arrays["exogenous"] = F.array(*[F.col(c).cast("double") for c in exogenous])
        widths["exogenous"] = len(exogenous)
    return base.withColumns({f"__a_{r}": a for r, a in arrays.items()}), widths


def fourier_array(position: Column, period: float, order: int) -> Column:
    """sin, cos, sin, cos, .. of the first `order` harmonics as one array."""
    turn = position * (2 * np.pi / period)
    waves = F.transform(F.sequence(F.lit(1), F.lit(order)), lambda k: F.array(F.sin(turn * k), F.cos(turn * k)))
    return F.flatten(waves)


def _targets(cap: float | None) -> dict[str, Column]:
    """The working target under each transform, scaled to about one."""
    y = F.col("__y")
    top = F.lit(float(cap)) if cap else F.col("__top") * 1.1
    share = F.try_divide(y, top)
    share = F.least(F.greatest(share, F.lit(0.001)), F.lit(0.999))
    return {
        "none": F.try_divide(y, F.col("__size")),
        "log": F.when(y > 0, F.log(y)),
        "logit": F.when(y.isNotNull() & (top > 0), F.log(share / (1 - share))),
    }


def _back(transform: Column | str, pred: Column, cap: float | None) -> Column:
    top = F.lit(float(cap)) if cap else F.col("__top") * 1.1
    kind = F.lit(transform) if isinstance(transform, str) else transform
    return (
        F.when(kind == "log", F.exp(F.least(pred, F.lit(700.0))))
        .when(kind == "logit", top / (1 + F.exp(-pred)))
        .otherwise(pred * F.col("__size"))
    )


def _roles(widths: Mapping[str, int], p: AdditiveParams) -> list[str]:
    """Column groups this parameter set uses, in a fixed order."""
    on = {
        "trend": p.growth != "flat",
        "hinge": p.growth != "flat",
        "yearly": p.yearly_seasonality,
        "weekly": p.weekly_seasonality,
        "daily": p.daily_seasonality,
        "holiday": True,
        "exogenous": True,
    }
    return [r for r, used in on.items() if used and r in widths]


def _penalty(widths: Mapping[str, int], roles: Sequence[str], p: AdditiveParams) -> np.ndarray:
    """1/scale^2 of each column (0 = free)."""
    season = p.seasonality_prior_scale
    scales = {
        "hinge": p.changepoint_prior_scale,
        "yearly": season,
        "weekly": season,
        "daily": season,
        "holiday": p.holidays_prior_scale,
    }
    return np.concatenate([np.full(widths[r], 1.0 / scales[r] ** 2 if r in scales else 0.0) for r in roles])


def _row(first: Sequence[Column], roles: Sequence[str]) -> Column:
    return F.concat(F.array(*first), *[F.col(f"__a_{r}") for r in roles])


def _hinges(widths: Mapping[str, int], roles: Sequence[str], p: AdditiveParams) -> np.ndarray:
    """1/scale of each hinge that may vanish (0 elsewhere): a Laplace prior keeps few breaks of the trend, and those whole."""
    on = p.changepoint_prior == "laplace"
    return np.concatenate([np.full(widths[r], 1.0 / p.changepoint_prior_scale if on and r == "hinge" else 0.0) for r in roles])


def _penalised(gram: np.ndarray, xs: list[int], pen: np.ndarray, at: np.ndarray):
    """Penalised fit whose noise level comes from a first, lightly penalised fit: 1/2 SSE + noise * (at * |b| + pen / 2 * b^2)."""
    n = gram[0, 0]
    light = np.where(pen > 0, 1e-6 * n, 0.0)
    b0, beta, used = fit(gram, xs, light)
    dof = max(n - len(used) - 1, 1.0)
    noise = max(residual_sum(gram, b0, beta, used) / dof, 1e-12)
    if not at.any():
        return fit(gram, xs, noise * pen)
    used = varying_columns(gram, xs)
    if not used:
        return fit(gram, xs, noise * pen)
    place = [xs.index(i) for i in used]
    n, mx, my, sxx, sxy, _ = centred(gram, used)
    beta = sparse_fit(sxx, sxy, noise * at[place], noise * np.where(at > 0, 0.0, pen)[place])
    return float(my - mx @ beta), beta, used


def _expanding(xs: list[int], pen: np.ndarray, at: np.ndarray, name: str):
    """The last two cells of a row are not regressors: they carry the key's scale to the output."""

    def run(m: KeyMoments) -> pd.DataFrame:
        out = []
        gram = m.total() if m.width else None
        for i, step in enumerate(m.steps):
            z, pred = m.rows[i], np.nan
            if gram[0, 0] >= 2:
                b0, beta, used = _penalised(gram, xs, pen, at)
                pred = b0 + (z[used] @ beta if used else 0.0)
            pred = None if not np.isfinite(pred) else float(pred)
            out.append((int(step), m.dates[i], name, pred, float(z[-2]), float(z[-1])))
            if m.complete(i):
                gram = gram + np.outer(z, z)
        return pd.DataFrame(out, columns=["step", "date", "model", "work", "__top", "__size"])

    return run


def additive_forecasts(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    params: AdditiveParams = AdditiveParams(),
    holidays: DataFrame | None = None,
    exogenous: Sequence[str] = (),
    changepoints: int = CHANGEPOINTS,
    name: str = "prophet",
) -> DataFrame:
    """Refitted at every origin; hinge positions and scales come from the rows before the first origin."""
    base, widths = _design(
        df, target=target, horizon=horizon, keys=keys, date=date, holidays=holidays, exogenous=exogenous,
        changepoints=changepoints,
    )
    roles = _roles(widths, params)
    pen, at = _penalty(widths, roles, params), _hinges(widths, roles, params)
    base = base.withColumn("__work", _targets(params.cap)[params.transform])
    z = F.concat(_row([F.lit(1.0), F.col("__work")], roles), F.array("__top", "__size"))
    parts = cross_products(base, z, width=4 + len(pen), keys=keys, date=date, step="step")
    xs = list(range(2, 2 + len(pen)))
    schema = "step int, date date, model string, work double, __top double, __size double"
    out = solve_per_key(parts, keys, _expanding(xs, pen, at, name), schema, carried=2)
    return out.select(*keys, "step", "date", "model", _back(params.transform, F.col("work"), params.cap).alias("pred"))


def _cutoff_fits(candidates):
    def run(m: KeyMoments) -> pd.DataFrame:
        out = []
        blocks = sorted(m.gram)
        gram = None
        for b in range(0, (max(blocks) if blocks else -1)):
            if b in m.gram:
                gram = m.gram[b] if gram is None else gram + m.gram[b]
            if gram is None or gram[0, 0] < 2:
                continue
            for index, xs, pen, at in candidates:
                b0, beta, used = _penalised(gram, xs, pen, at)
                out.append((b, index, m.plain(b0, beta, used).tolist()))
        return pd.DataFrame(out, columns=["cut", "candidate", "coef"])

    return run


def additive_search(
    df: DataFrame,
    candidates: Sequence[AdditiveParams],
    *,
    target: str,
    horizon: int,
    initial_days: int,
    horizon_days: int,
    keys: Sequence[str] = (),
    date: str = "date",
    holidays: DataFrame | None = None,
    exogenous: Sequence[str] = (),
    changepoints: int = CHANGEPOINTS,
) -> DataFrame:
    """(keys, candidate, rmse) of every candidate over expanding cutoffs.

    Cutoffs step back from (last training date - horizon) by half a horizon while `initial_days` remain. The rows
    between two cutoffs form one block, so prefix sums of the block cross products train every cutoff; scoring joins
    the fitted coefficients back to the rows of the following horizon.
    """
    base, widths = _design(
        df, target=target, horizon=horizon, keys=keys, date=date, holidays=holidays, exogenous=exogenous,
        changepoints=changepoints,
    )
    base = cut_lineage(base.filter(F.col("step").isNull()))  # read again by every fit and every scoring
    period = max(horizon_days // 2, 1)
    newest = F.date_sub("__last", horizon_days)
    count = F.floor(F.datediff(newest, F.date_add("__first", initial_days)) / period)  # cutoffs - 1
    oldest = F.date_sub(newest, (count * period).cast("int"))
    # block b holds the rows up to cutoff b that are after cutoff b-1; the rows after the newest cutoff come last
    late = F.ceil(F.datediff(F.to_date(date), oldest) / period)
    block = F.when(count < 0, F.lit(0)).otherwise(F.least(F.greatest(late, F.lit(0)), count + 1)).cast("int")
    base = base.withColumns({"__block": block, "__cuts": F.greatest(count + 1, F.lit(0)).cast("int"), "__oldest": oldest})
    results = None
    by_kind: dict[tuple, list] = {}
    for i, p in enumerate(candidates):
        by_kind.setdefault((p.transform, p.cap), []).append((i, p))
    for (kind, cap), members in by_kind.items():
        union = [r for r in widths if any(r in _roles(widths, p) for _, p in members)]
        at, place = {}, 2
        for r in union:
            at[r] = list(range(place, place + widths[r]))
            place += widths[r]
        work = base.withColumn("__work", _targets(cap)[kind])
        z = _row([F.lit(1.0), F.col("__work")], union)
        parts = cross_products(work, z, width=place, keys=keys, date=date, block="__block")
        plans = []
        for i, p in members:
            roles = _roles(widths, p)
            plans.append((i, [c for r in roles for c in at[r]], _penalty(widths, roles, p), _hinges(widths, roles, p)))
        fits = solve_per_key(parts, keys, _cutoff_fits(plans), "cut int, candidate int, coef array<double>", carried=0)
        row = _row([F.lit(1.0), F.lit(0.0)], union)
        # a row is scored by the cutoffs less than a horizon before it: a few numbers, not all cutoffs
        late_from = F.floor(F.datediff(F.to_date(date), F.date_add("__oldest", horizon_days)) / period).cast("int")
        reach = horizon_days // period + 2
        tested = work.filter(F.col("__cuts") > 0).select(
            *keys, F.col(date).alias("date"), "__y", "__top", "__size", row.alias("z"),
            F.explode(F.filter(F.sequence(late_from, late_from + reach), lambda c: (c >= 0) & (c < F.col("__cuts")))).alias("cut"), "__oldest",
        )
        cutoff = F.date_add("__oldest", F.col("cut") * period)
        tested = tested.filter((F.col("date") > cutoff) & (F.col("date") <= F.date_add(cutoff, horizon_days)))
        joined = join_keys(tested, fits, [*keys, "cut"])
        dot = F.aggregate(F.zip_with("z", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        miss = F.col("__y") - _back(kind, dot, cap)
        scored = joined.groupBy(*keys, "candidate").agg(F.sqrt(F.avg(miss * miss)).alias("rmse"))
        results = scored if results is None else results.unionByName(scored)
    return results


def best_additive(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, candidate): the lowest error, the first candidate on ties."""
    rank = F.when(F.col("rmse").isNotNull() & ~F.isnan("rmse"), F.struct("rmse", "candidate"))
    return scores.groupBy(*keys).agg(F.min_by("candidate", rank).alias("candidate"))
