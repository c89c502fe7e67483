"""Order-searched ARMA forecasts by the two-stage least-squares method of Hannan and Rissanen (1982).

Stage one fits a long autoregression per key and turns its residuals into a column; stage two regresses on lags of
the series and of those residuals. Both stages are cross-product aggregations, and one stage-two aggregation serves
every (p, q) and every origin.

`method="likelihood"` goes on from there: conditional maximum likelihood by Gauss-Newton steps. A series, which the calendar
bounds, is read in order once a step; residuals and their derivatives follow by recursion for all (p, q) at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.frame import attach, by_time, spread, whole, with_step
from chronoloom.operators.gram import KeyMoments, cross_products, fit, gaussian_criterion, least_squares, residual_sum, solve_per_key
from chronoloom.operators.stationarity import choose_difference
from chronoloom.operators.transforms import differences
from chronoloom.session import cut_lineage


def _long_fit(m: KeyMoments) -> pd.DataFrame:
    out = []
    if m.width:
        xs = list(range(2, m.width))
        gram = m.total()
        if gram[0, 0] > len(xs) + 2:
            b0, beta, used = fit(gram, xs)
            out.append((m.plain(b0, beta, used).tolist(),))
    return pd.DataFrame(out, columns=["coef"])


def _order_search(max_p: int, max_q: int, exogenous: int, criterion: str, name: str):
    """z = [1, w, w_lag1..p, e_lag1..q, exogenous.., d, base]; every origin picks its own order.

    `base` is what the differencing of order `d` took off the origin's value, so adding it restores the level.
    """
    ar = list(range(2, 2 + max_p))
    ma = list(range(2 + max_p, 2 + max_p + max_q))
    exo = list(range(2 + max_p + max_q, 2 + max_p + max_q + exogenous))
    designs = [(p, q, ar[:p] + ma[:q] + exo) for p in range(max_p + 1) for q in range(max_q + 1)]

    def run(m: KeyMoments) -> pd.DataFrame:
        out = []
        gram = m.total() if m.width else None
        for i, step in enumerate(m.steps):
            z, best = m.rows[i], None
            if gram[0, 0] > 0:
                for p, q, xs in designs:
                    if gram[0, 0] <= len(xs) + 2:
                        continue
                    b0, beta, used = fit(gram, xs)
                    score = gaussian_criterion(residual_sum(gram, b0, beta, used), gram[0, 0], len(used) + 2, criterion)
                    if best is None or score < best[0]:
                        best = (score, b0 + (z[used] @ beta if used else 0.0), p, q)
            level = best[1] + z[-1] if best else np.nan
            found = (best[2], best[3]) if best else (None, None)
            out.append((int(step), m.dates[i], name, level if np.isfinite(level) else None, int(z[-2]), *found))
            if m.complete(i):
                gram = gram + np.outer(z, z)
        return pd.DataFrame(out, columns=["step", "date", "model", "pred", "d", "p", "q"])

    return run


class ArmaFit:
    """Conditional least squares of several ARMA designs on one series, side by side.

    Parameters of a design are [constant, p autoregressive, q moving-average, regressors], padded to the largest p and q.
    Residuals before the first complete row are 0. A step is kept for a design only if its sum of squares falls.
    """

    def __init__(self, w: np.ndarray, x: np.ndarray, designs: Sequence[tuple[int, int]], max_p: int, max_q: int):
        self.w, self.x, self.p, self.q = w, x, max_p, max_q
        width = 1 + max_p + max_q + x.shape[1]
        self.ma = slice(1 + max_p, 1 + max_p + max_q)
        self.used = np.zeros((len(designs), width), bool)
        for row, (p, q) in zip(self.used, designs):
            row[: 1 + p] = row[1 + max_p : 1 + max_p + q] = row[1 + max_p + max_q :] = True
        lagged = np.column_stack([np.r_[np.full(i, np.nan), w[: len(w) - i]] for i in range(1, max_p + 1)]) if max_p else np.empty((len(w), 0))
        self.known = np.column_stack([np.ones(len(w)), lagged, np.zeros((len(w), max_q)), x])
        self.ready = np.isfinite(self.known).all(axis=1)

    def scan(self, beta: np.ndarray, rows: int, origins: Sequence[int] = ()) -> tuple:
        """(sums of squares, g'e, g'g, rows, states): g is the derivative of the residual e; states are what is known at `origins`."""
        c, width = beta.shape
        theta = beta[:, self.ma]
        e, g = np.zeros((c, self.q)), np.zeros((c, self.q, width))  # newest first
        square, pull, curve, n = np.zeros(c), np.zeros((c, width)), np.zeros((c, width, width)), 0
        asked, states = set(origins), {}
        with np.errstate(all="ignore"):
            for t in range(rows):
                if not self.ready[t]:
                    if t in asked:
                        states[t] = None
                    continue
                z = np.repeat(self.known[t][None, :], c, axis=0)
                z[:, self.ma] = e
                guess = (z * beta).sum(axis=1)
                slope = -np.where(self.used, z, 0.0)
                if self.q:
                    slope = slope - (theta[:, :, None] * g).sum(axis=1)
                if t in asked:
                    states[t] = (guess, slope, square.copy(), pull.copy(), curve.copy(), n)
                if not np.isfinite(self.w[t]):
                    error, slope = np.zeros(c), np.zeros_like(slope)
                else:
                    error = self.w[t] - guess
                    square += error * error
                    pull += slope * error[:, None]
                    curve += slope[:, :, None] * slope[:, None, :]
                    n += 1
                if self.q:
                    e = np.concatenate([error[:, None], e[:, :-1]], axis=1)
                    g = np.concatenate([slope[:, None, :], g[:, :-1]], axis=1)
        return square, pull, curve, n, states

    def step(self, pull: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """The Gauss-Newton step of each design."""
        out = np.zeros_like(pull)
        for i, used in enumerate(self.used):
            on = np.flatnonzero(used)
            if np.isfinite(curve[i]).all() and np.isfinite(pull[i]).all():
                out[i, on] = -least_squares(curve[i][np.ix_(on, on)], pull[i][on])
        return out

    def estimate(self, start: np.ndarray, rows: int, scans: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parameters, sums of squares, those at the start) on the first `rows` rows."""
        best = np.where(self.used, start, 0.0)
        square, pull, curve, *_ = self.scan(best, rows)
        wild = ~np.isfinite(square) | (square > np.nanvar(self.w[:rows]) * 10 * rows)
        if wild.any():  # not invertible: without the moving average
            best[wild, self.ma] = 0.0
            square, pull, curve, *_ = self.scan(best, rows)
        first, move, share = square, self.step(pull, curve), np.ones(len(best))
        for _ in range(scans):
            tried = best + share[:, None] * move
            s, p, c, *_ = self.scan(tried, rows)
            good = np.isfinite(s) & (s < square)
            gain = np.where(good, square - s, 0.0)
            best = np.where(good[:, None], tried, best)
            again = self.step(np.where(good[:, None], p, 0.0), np.where(good[:, None, None], c, 0.0))
            move = np.where(good[:, None], again, move)
            share = np.where(good, 1.0, share / 4)
            square = np.where(good, s, square)
            if ((gain <= 1e-9 * square) & (good | (share < 1e-3))).all():
                break
        return best, square, first


def _starts(designs: list[tuple[int, int, list[int]]]):
    """Two-stage estimates of every (p, q), as rows of the design came."""

    def run(m: KeyMoments) -> pd.DataFrame:
        out = []
        gram = m.total() if m.width else None
        for p, q, xs in designs:
            if m.width and gram[0, 0] > len(xs) + 2:
                out.append((p, q, m.plain(*fit(gram, xs)).tolist()))
        return pd.DataFrame(out, columns=["p", "q", "coef"])

    return run


def _likelihood(keys: list[str], max_p: int, max_q: int, exogenous: int, criterion: str, name: str):
    """Forecasts of one series at its origins. Parameters come from the rows before the first origin; at a later origin one
    more Gauss-Newton step, from the sums of all rows before it, brings them up to date."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        held = next((v for v in pdf["starts"] if v is not None), None)
        step = pdf["step"].to_numpy(dtype=float)
        origins = np.flatnonzero(np.isfinite(step))
        out = [[int(step[t]), pdf["date"][t], name, None, int(pdf["d"][t]), None, None] for t in origins]
        if held is not None and len(held) and len(origins):
            w, x = pdf["w"].to_numpy(dtype=float), np.column_stack([pdf[f"x{i}"].to_numpy(dtype=float) for i in range(exogenous)]) if exogenous else np.empty((len(pdf), 0))
            fits = ArmaFit(w, x, [(h["p"], h["q"]) for h in held], max_p, max_q)
            start = np.array([[v[0], *v[2 : 2 + max_p + max_q + exogenous]] for v in (np.asarray(h["coef"], dtype=float) for h in held)])
            beta, *_ = fits.estimate(start, int(origins[0]))
            *_, states = fits.scan(beta, len(pdf), origins.tolist())
            size = fits.used.sum(axis=1)
            for row, t in zip(out, origins):
                if states.get(t) is None:
                    continue
                guess, slope, square, pull, curve, n = states[t]
                move = fits.step(pull, curve)
                left = np.maximum(square + (pull * move).sum(axis=1), 0.0)
                scores = [gaussian_criterion(s, n, int(k) + 1, criterion) if n > k + 1 else np.inf for s, k in zip(left, size)]
                pick = int(np.argmin(scores))
                pred = guess[pick] - slope[pick] @ move[pick] + float(pdf["base"][t])
                if np.isfinite(scores[pick]) and np.isfinite(pred):
                    row[3], row[5], row[6] = float(pred), int(held[pick]["p"]), int(held[pick]["q"])
        res = pd.DataFrame(out, columns=["step", "date", "model", "pred", "d", "p", "q"])
        for k in reversed(keys):
            res.insert(0, k, pd.Series([pdf[k].iloc[0]] * len(res), dtype=pdf[k].dtype))
        return res

    return run


def difference_orders(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    max_d: int = 2,
    max_test_lag: int | None = None,
) -> DataFrame:
    """(keys, .., diff_order) by repeated unit-root tests on the rows before the first origin."""
    base = df if "step" in df.columns else with_step(df.select(*keys, date, target), keys, horizon, date)
    train = base.filter(F.col("step").isNull()).select(*keys, date, F.col(target).cast("double").alias("__y"))
    train = differences(train, "__y", keys, date, max_d)
    return choose_difference(train, "__y", keys=keys, date=date, max_order=max_d, max_lag=max_test_lag)


def arima_forecasts(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    d: int | None = None,
    max_d: int = 2,
    max_p: int = 4,
    max_q: int = 4,
    exogenous: Sequence[str] = (),
    long_lags: int | None = None,
    criterion: str = "AIC",
    max_test_lag: int | None = None,
    orders: DataFrame | None = None,
    stored: bool = False,
    method: str = "two_stage",
    name: str = "arima_diff",
    detail: bool = False,
) -> DataFrame:
    """One-step forecasts on the scale of `target`. `d=None` takes the differencing order per key from `orders`, by
    default `difference_orders`; exogenous columns are differenced alongside. `method` is "two_stage" or "likelihood"
    (conditional, from the two-stage start); a key too short for the start gets no forecast. `stored` says that `df` is already
    written, so its several readers need no lineage cut here."""
    keys = list(keys)
    base = df.select(*keys, date, F.col(target).cast("double").alias("__y"), *exogenous)
    base = with_step(base, keys, horizon, date)
    if not stored:  # the stages below read it once each
        base = cut_lineage(base)
    w = by_time(keys, date)
    if d is None:
        if orders is None:
            orders = difference_orders(
                base, target="__y", horizon=horizon, keys=keys, date=date, max_d=max_d, max_test_lag=max_test_lag
            )
        base = attach(base, orders.select(*keys, F.col("diff_order").alias("__d")), keys, "left")
    else:
        base = base.withColumn("__d", F.lit(int(d)))

    def differenced(c: str):
        one = F.col(c) - F.lag(c, 1).over(w)
        two = F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)
        return F.when(F.col("__d") == 1, one).when(F.col("__d") == 2, two).otherwise(level_free(c))

    def level(c: str):
        return F.coalesce(F.avg(F.col(c).cast("double")).over(whole(keys)), F.lit(0.0))

    def level_free(c: str):
        return F.col(c).cast("double") - level(c)

    top = 0 if d == 0 else (max_d if d is None else d)
    y1, y2 = F.lag("__y", 1).over(w), F.lag("__y", 2).over(w)
    taken = F.when(F.col("__d") == 1, y1).when(F.col("__d") == 2, 2 * y1 - y2).otherwise(level("__y"))
    work = {"__w": differenced("__y") if top else level_free("__y"), "__base": taken if top else level("__y")}
    work |= {f"__x{i}": differenced(c) if top else level_free(c) for i, c in enumerate(exogenous)}
    base = base.withColumns(work)
    xs = [f"__x{i}" for i in range(len(exogenous))]
    long = long_lags or max_p + max_q + 4
    lags = {f"__w{i}": F.lag("__w", i).over(w) for i in range(1, long + 1)}
    base = base.withColumns(lags)
    first = cross_products(
        base.filter(F.col("step").isNull()), [F.lit(1.0), "__w", *lags, *xs], keys=keys, date=date
    )
    coefs = solve_per_key(first, keys, _long_fit, "coef array<double>", carried=0)
    base = attach(base, coefs, keys, "left")
    z = F.array(F.lit(1.0), F.lit(0.0), *[F.col(c) for c in [*lags, *xs]])
    fitted = F.aggregate(F.zip_with(z, "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    base = base.withColumn("__e", F.col("__w") - fitted)
    ma = {f"__e{i}": F.lag("__e", i).over(w) for i in range(1, max_q + 1)}
    base = base.withColumns(ma)
    ar = [f"__w{i}" for i in range(1, max_p + 1)]
    z2 = [F.lit(1.0), "__w", *ar, *ma, *xs, "__d", "__base"]
    second = cross_products(base, z2, keys=keys, date=date, step="step")
    columns = [*keys, "step", "date", "model", "pred", *(["d", "p", "q"] if detail else [])]
    if method == "likelihood":
        designs = [(p, q, [*range(2, 2 + p), *range(2 + max_p, 2 + max_p + q), *range(2 + max_p + max_q, 2 + max_p + max_q + len(xs))])
                   for p in range(max_p + 1) for q in range(max_q + 1)]
        starts = solve_per_key(second, keys, _starts(designs), "p int, q int, coef array<double>", carried=2)
        held = starts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", "q", "coef"))).alias("starts"))  # one entry a design
        rows = base.select(*keys, F.col(date).alias("date"), "step", F.col("__row").alias("at"), F.col("__w").alias("w"), F.col("__base").alias("base"), F.col("__d").alias("d"),
                           *[F.col(c).alias(f"x{i}") for i, c in enumerate(xs)])
        rows = attach(rows, held, keys, "left").withColumn("starts", F.when(F.col("at") == 1, F.col("starts"))).drop("at")
        schema = T.StructType([df.schema[k] for k in keys] + list(T._parse_datatype_string("step int, date date, model string, pred double, d int, p int, q int").fields))
        out = spread(rows, keys).groupBy(*keys).applyInPandas(_likelihood(keys, max_p, max_q, len(xs), criterion, name), schema)
        return out.select(*columns)
    if method != "two_stage":
        raise ValueError(f"method is 'two_stage' or 'likelihood', not {method!r}")
    run = _order_search(max_p, max_q, len(xs), criterion, name)
    out = solve_per_key(second, keys, run, "step int, date date, model string, pred double, d int, p int, q int", carried=2)
    return out.select(*columns)
