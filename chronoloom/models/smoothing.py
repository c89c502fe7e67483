"""Exponential smoothing as an ordered scan.

Rows arrive sorted by key and time inside each partition. A task gathers some hundred series and steps through time once,
with arrays of (series, parameter grid point); every origin gets its forecast and its best grid point from that pass. A
series is bounded by the calendar, so what a task holds is too.

`refine` rounds go on from there: each tries the neighbours, half as far away as in the round before, of every point that
some origin of the series holds to be best. An origin's own point is among them, so its error never rises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.frame import spread, with_step

# Smoothing weights tried, and the seasonal candidates in declared order.
HOLT_WEIGHTS = (0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99)
SEASONAL_WEIGHTS = (0.05, 0.2, 0.4, 0.6, 0.9)
TRENDS = ("add", "mul")
SEASONS = ("add", "mul")
PERIODS = (4, 7, 15, 30)


def _weights(grid: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """One (series, points) array per weight, for the series `at`."""
    return iter(np.moveaxis(grid if grid.shape[0] == 1 else grid[at], 2, 0))


def _best_points(grid: np.ndarray, sse: np.ndarray) -> np.ndarray:
    """(series, weights): the point of least error of each series."""
    best = np.argmin(np.where(np.isfinite(sse), sse, np.inf), axis=1)
    return grid[0][best] if grid.shape[0] == 1 else grid[np.arange(len(best)), best]


class HoltPanel:
    """Linear trends of many series over a grid of (level, trend) weights, with the running sum of squared errors of each.

    Arrays are (series, grid point); one call moves every series that has a value by one step.
    """

    def __init__(self, series: int, alphas: Sequence[float], betas: Sequence[float], grid: np.ndarray | None = None):
        """`grid` (series, points, 2) gives every series points of its own, in place of the product of the weights."""
        self.grid = np.array(list(product(alphas, betas)))[None] if grid is None else grid
        self.sse = np.zeros((series, self.grid.shape[1]))
        self.level, self.trend = np.full_like(self.sse, np.nan), np.full_like(self.sse, np.nan)
        self.first = np.full(series, np.nan)
        self.begun = np.zeros(series, bool)

    def forecasts(self) -> np.ndarray:
        best = np.argmin(self.sse, axis=1)
        ahead = np.take_along_axis(self.level + self.trend, best[:, None], axis=1)[:, 0]
        return np.where(self.begun, ahead, self.first)

    def updates(self, y: np.ndarray) -> None:
        known = np.isfinite(y)
        go = np.flatnonzero(known & self.begun)
        start = np.flatnonzero(known & ~self.begun & np.isfinite(self.first))
        fresh = np.flatnonzero(known & ~self.begun & ~np.isfinite(self.first))
        if go.size:
            v = y[go, None]
            ahead = self.level[go] + self.trend[go]
            self.sse[go] += (v - ahead) ** 2
            a, b = _weights(self.grid, go)
            level = a * v + (1 - a) * ahead
            self.trend[go] = b * (level - self.level[go]) + (1 - b) * self.trend[go]
            self.level[go] = level
        self.level[start], self.trend[start] = y[start, None], (y - self.first)[start, None]
        self.begun[start] = True
        self.first[fresh] = y[fresh]


class SeasonalPanel:
    """One (trend, season, period) candidate for many series over a grid of three weights; starts after two full cycles."""

    def __init__(self, series: int, trend: str, season: str, period: int, weights: Sequence[float], grid: np.ndarray | None = None):
        """`grid` (series, points, 3) gives every series points of its own, in place of the product of the weights."""
        self.grid = np.array(list(product(weights, repeat=3)))[None] if grid is None else grid
        self.trend_kind, self.season_kind, self.m = trend, season, period
        self.seen, self.filled = np.full((series, 2 * period), np.nan), np.zeros(series, int)
        self.sse = np.zeros((series, self.grid.shape[1]))
        self.level, self.trend = np.full_like(self.sse, np.nan), np.full_like(self.sse, np.nan)
        self.season = np.full((*self.sse.shape, period), np.nan)
        self.n = np.zeros(series, int)
        self.dead, self.begun = np.zeros(series, bool), np.zeros(series, bool)

    def _ahead(self, at: np.ndarray):
        base = self.level[at] + self.trend[at] if self.trend_kind == "add" else self.level[at] * self.trend[at]
        s = self.season[at, :, self.n[at] % self.m]
        return base, s, (base + s if self.season_kind == "add" else base * s)

    def criteria(self) -> np.ndarray:
        """n ln(SSE/n) + 2k with the three weights, two starting states and the period's seasonal states."""
        sse, n = self.sse.min(axis=1), np.maximum(self.n, 1)
        score = n * np.log(np.maximum(sse, 1e-300) / n) + 2 * (5 + self.m)
        return np.where(self.dead | ~self.begun | (self.n == 0) | ~np.isfinite(sse), np.inf, score)

    def forecasts(self) -> np.ndarray:
        out = np.full(len(self.n), np.nan)
        at = np.flatnonzero(self.begun & ~self.dead)
        if at.size:
            best = np.argmin(self.sse[at], axis=1)
            out[at] = np.take_along_axis(self._ahead(at)[2], best[:, None], axis=1)[:, 0]
        return out

    def updates(self, y: np.ndarray) -> None:
        known = np.isfinite(y) & ~self.dead
        if "mul" in (self.trend_kind, self.season_kind):
            self.dead |= known & (y <= 0)
            known &= ~self.dead
        go = np.flatnonzero(known & self.begun)
        wait = np.flatnonzero(known & ~self.begun)
        if go.size:
            self._step(go, y[go])
        self.seen[wait, self.filled[wait]] = y[wait]
        self.filled[wait] += 1
        ready = wait[self.filled[wait] == 2 * self.m]
        if ready.size:
            self._start(ready)

    def _start(self, at: np.ndarray) -> None:
        history = self.seen[at]
        first, second = history[:, : self.m].mean(axis=1), history[:, self.m :].mean(axis=1)
        slope = (second - first) / self.m if self.trend_kind == "add" else (second / first) ** (1.0 / self.m)
        self.level[at], self.trend[at] = first[:, None], slope[:, None]
        cycle = history[:, : self.m]
        cycle = cycle - first[:, None] if self.season_kind == "add" else cycle / first[:, None]
        self.season[at] = cycle[:, None, :]
        self.begun[at] = True
        for k in range(2 * self.m):
            self._step(at, history[:, k])

    def _step(self, at: np.ndarray, values: np.ndarray) -> None:
        y = values[:, None]
        base, s, ahead = self._ahead(at)
        sse = self.sse[at] + (y - ahead) ** 2
        bare = y - s if self.season_kind == "add" else y / s
        a, b, g = _weights(self.grid, at)
        level = a * bare + (1 - a) * base
        grown = level - self.level[at] if self.trend_kind == "add" else level / self.level[at]
        self.trend[at] = b * grown + (1 - b) * self.trend[at]
        moved = y - base if self.season_kind == "add" else y / base
        self.season[at, :, self.n[at] % self.m] = g * moved + (1 - g) * s
        self.level[at] = level
        self.n[at] += 1
        check = self.n[at] % 16 == 0  # a grid point that has blown up can never win
        sse[check[:, None] & (~np.isfinite(sse) | ~np.isfinite(level))] = np.inf
        self.sse[at] = sse


class SeasonalPool:
    """All seasonal candidates; for every series the lowest criterion gives the forecast, earlier candidates win ties."""

    def __init__(self, series: int, trends, seasons, periods, weights):
        self.parts = [SeasonalPanel(series, t, s, m, weights) for t in trends for s in seasons for m in periods]

    def chosen(self) -> np.ndarray:
        """The winning candidate of each series, -1 where none can be fitted."""
        with np.errstate(all="ignore"):
            scores = np.stack([p.criteria() for p in self.parts])
        best = np.argmin(scores, axis=0)
        return np.where(np.isfinite(scores[best, np.arange(scores.shape[1])]), best, -1)

    def forecasts(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            values = np.stack([p.forecasts() for p in self.parts])
        best = self.chosen()
        return np.where(best >= 0, values[best, np.arange(values.shape[1])], np.nan)

    def updates(self, y: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            for p in self.parts:
                p.updates(y)


class HoltSearch:
    """What a task asks of linear trends: the panel of the grid, then panels about the best points of one kind of candidate."""

    def __init__(self, alphas: Sequence[float], betas: Sequence[float]):
        self.alphas, self.betas = alphas, betas
        self.gaps = np.array([_gap(alphas), _gap(betas)])
        self.states = [4]  # numbers kept per series and point, for each candidate

    def __call__(self, series: int) -> HoltPanel:
        return HoltPanel(series, self.alphas, self.betas)

    def chosen(self, state: HoltPanel) -> np.ndarray:
        return np.where(state.begun, 0, -1)

    def candidate(self, state: HoltPanel, kind: int) -> HoltPanel:
        return state

    def about(self, kind: int, grid: np.ndarray) -> HoltPanel:
        return HoltPanel(len(grid), (), (), grid)


class SeasonalSearch:
    """The same for seasonal candidates: `kind` counts trends, seasons and periods in declared order."""

    def __init__(self, trends: Sequence[str], seasons: Sequence[str], periods: Sequence[int], weights: Sequence[float]):
        self.parts = trends, seasons, periods, weights
        self.kinds = list(product(trends, seasons, periods))
        self.gaps = np.full(3, _gap(weights))
        self.states = [m + 8 for _, _, m in self.kinds]

    def __call__(self, series: int) -> SeasonalPool:
        return SeasonalPool(series, *self.parts)

    def chosen(self, state: SeasonalPool) -> np.ndarray:
        return state.chosen()

    def candidate(self, state: SeasonalPool, kind: int) -> SeasonalPanel:
        return state.parts[kind]

    def about(self, kind: int, grid: np.ndarray) -> SeasonalPanel:
        return SeasonalPanel(len(grid), *self.kinds[kind], (), grid)


def _gap(weights: Sequence[float]) -> float:
    """Half the widest distance of neighbouring weights: no weight between the outermost is farther from the grid."""
    values = np.sort(np.asarray(weights, float))
    return float(np.max(np.diff(values)) / 2) if len(values) > 1 else 0.25


SERIES_AT_ONCE = 256
ROWS_AT_ONCE = 200_000
NUMBERS_AT_ONCE = 4_000_000  # states of the points tried side by side in a round of refinement
LEAST_WEIGHT = 1e-4


def _neighbours(centres: np.ndarray, asked: np.ndarray, width: np.ndarray) -> np.ndarray:
    """(series, points, weights): all points one `width` up or down, in any of the weights, from what the origins of a series
    hold. Series with fewer points than others repeat their first."""
    moves = np.array(list(product((0.0, -1.0, 1.0), repeat=len(width)))) * width
    own = [np.unique(c[a], axis=0) for c, a in zip(centres, asked)]
    own = [np.unique(np.vstack([c, np.clip(c[:, None] + moves, LEAST_WEIGHT, 1 - LEAST_WEIGHT).reshape(-1, len(width))]), axis=0) for c in own]
    most = max(len(c) for c in own)
    return np.stack([np.vstack([c, np.repeat(c[:1], most - len(c), axis=0)]) for c in own])


def _polish(search, kind: int, y: np.ndarray, asked: np.ndarray, centres: np.ndarray, found: np.ndarray, losses: np.ndarray, rounds: int) -> None:
    """Moves `centres`, `found` and `losses` (in place) of the origins `asked` to better points of one candidate."""
    width = search.gaps.copy()
    for _ in range(rounds):
        busy = np.flatnonzero(asked.any(axis=1))
        most = 3 ** len(width) * int(asked.sum(axis=1).max())
        size = max(1, NUMBERS_AT_ONCE // (most * search.states[kind]))
        for some in (busy[i : i + size] for i in range(0, len(busy), size)):
            panel = search.about(kind, _neighbours(centres[some], asked[some], width))
            last = int(np.flatnonzero(asked[some].any(axis=0)).max())
            with np.errstate(all="ignore"):
                for t in range(last + 1):
                    here = asked[some, t]
                    if here.any():
                        at = some[here]
                        centres[at, t] = _best_points(panel.grid, panel.sse)[here]
                        found[at, t] = panel.forecasts()[here]
                        losses[at, t] = np.where(np.isfinite(panel.sse), panel.sse, np.inf).min(axis=1)[here]
                    panel.updates(y[some, t])
        width = width / 2


def moved_through(search, y: np.ndarray, asked: np.ndarray, rounds: int = 0, detail: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts of the positions `asked` of the series `y` (both series x time) and, if refined or in `detail`, the sums of
    squared errors before them."""
    found, losses = np.full(y.shape, np.nan), np.full(y.shape, np.nan)
    state = search(len(y))
    keep = bool(rounds) or detail
    if keep:
        kinds, centres = np.full(y.shape, -1), np.full((*y.shape, len(search.gaps)), np.nan)
    for t in range(y.shape[1]):
        here = np.flatnonzero(asked[:, t])
        if here.size:
            found[:, t] = state.forecasts()
        if here.size and keep:
            kinds[here, t] = search.chosen(state)[here]
            for kind in np.unique(kinds[here, t][kinds[here, t] >= 0]):
                part, at = search.candidate(state, kind), here[kinds[here, t] == kind]
                centres[at, t] = _best_points(part.grid, part.sse)[at]
                losses[at, t] = np.where(np.isfinite(part.sse), part.sse, np.inf).min(axis=1)[at]
        state.updates(y[:, t])
    if rounds:
        for kind in np.unique(kinds[kinds >= 0]):
            _polish(search, kind, y, kinds == kind, centres, found, losses, rounds)
    return found, losses


def _panel(rows: pd.DataFrame, keys: list[str], make: Callable[[int], object], name: str, rounds: int = 0, detail: bool = False) -> pd.DataFrame:
    """Forecasts of whole series, moved through time side by side."""
    changed = np.zeros(len(rows), bool)
    changed[0] = True
    for k in keys:
        values = rows[k]
        same = (values == values.shift()) | (values.isna() & values.shift().isna())
        changed |= ~same.to_numpy(dtype=bool)
    changed[0] = True
    series = np.cumsum(changed) - 1
    begin = np.flatnonzero(changed)
    place = np.arange(len(rows)) - begin[series]
    count, length = len(begin), int(place.max()) + 1
    y = np.full((count, length), np.nan)
    y[series, place] = rows["y"].to_numpy(dtype=float)
    asked = np.zeros((count, length), bool)
    step = rows["step"].to_numpy()
    asked[series, place] = step >= 0
    found, losses = moved_through(make, y, asked, rounds, detail)
    out = rows.loc[step >= 0, [*keys, "step", "date"]].copy()
    out["model"] = name
    pred = found[series, place][step >= 0]
    out["pred"] = np.where(np.isfinite(pred), pred, np.nan)
    if detail:
        out["loss"] = losses[series, place][step >= 0]
    return out


def _panels(rows: pd.DataFrame, keys: list[str], make: Callable[[int], object], name: str, *more) -> Iterator[pd.DataFrame]:
    """Whole series, SERIES_AT_ONCE of them side by side: a panel's memory has that bound, however short its series are."""
    ends = np.flatnonzero(rows["last"].to_numpy()) + 1
    cuts = [0, *ends[SERIES_AT_ONCE - 1 : -1 : SERIES_AT_ONCE].tolist(), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield _panel(rows.iloc[a:b].reset_index(drop=True), keys, make, name, *more)


def _scan(keys: list[str], make: Callable[[int], object], name: str, *more):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Gathers whole series (at most about SERIES_AT_ONCE of them or ROWS_AT_ONCE rows) and moves them together."""
        held: list[pd.DataFrame] = []
        rows = ends = 0
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            rows += len(pdf)
            ends += int((pdf["last"]).sum())
            if ends >= SERIES_AT_ONCE or rows >= ROWS_AT_ONCE:
                whole = pd.concat(held, ignore_index=True)
                cut = np.flatnonzero(whole["last"].to_numpy())
                if not len(cut):
                    continue  # one series that goes on
                yield from _panels(whole.iloc[: cut[-1] + 1], keys, make, name, *more)
                held = [whole.iloc[cut[-1] + 1 :]]
                rows, ends = len(held[0]), 0
        left = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(left):
            yield from _panels(left, keys, make, name, *more)

    return run


def ordered_scan(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    make: Callable[[int], object],
    name: str,
    keys: Sequence[str] = (),
    date: str = "date",
    refine: int = 0,
    detail: bool = False,
) -> DataFrame:
    """Moves many series at a time through a state from `make(number of series)`; forecasts are taken before each of the
    newest `horizon` rows updates it. `refine` rounds need a search with candidates, such as HoltSearch;
    `detail` adds the sum of squared errors (loss) that the weights were chosen by."""
    keys = list(keys)
    base = spread(df.select(*keys, date, F.col(target).cast("double").alias("y")), keys)
    base = with_step(base, keys, horizon, date)
    # Window output is already sorted by (keys, date) within partitions; state it, the planner drops the extra sort.
    rows = base.select(
        *keys, F.col(date).alias("date"), "y", F.coalesce("step", F.lit(-1)).alias("step"),
        (F.col("__row") == F.col("__rows")).alias("last"))
    rows = rows.sortWithinPartitions(*keys, "date")
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("step", T.IntegerType()),
            T.StructField("date", df.schema[date].dataType),
            T.StructField("model", T.StringType()),
            T.StructField("pred", T.DoubleType()),
        ]
        + ([T.StructField("loss", T.DoubleType())] if detail else [])
    )
    return rows.mapInPandas(_scan(keys, make, name, *([refine, detail] if refine or detail else [])), schema)


def holt_forecasts(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    alphas: Sequence[float] = HOLT_WEIGHTS,
    betas: Sequence[float] = HOLT_WEIGHTS,
    refine: int = 0,
    detail: bool = False,
    name: str = "holt",
) -> DataFrame:
    """Linear trend; weights are those with the lowest one-step squared error so far, chosen anew at every origin: those of
    the grid, or what `refine` rounds of halved steps find from there."""
    return ordered_scan(
        df, target=target, horizon=horizon, make=HoltSearch(alphas, betas), name=name, keys=keys, date=date, refine=refine, detail=detail
    )


def seasonal_forecasts(
    df: DataFrame,
    *,
    target: str,
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    trends: Sequence[str] = TRENDS,
    seasons: Sequence[str] = SEASONS,
    periods: Sequence[int] = PERIODS,
    weights: Sequence[float] = SEASONAL_WEIGHTS,
    refine: int = 0,
    detail: bool = False,
    name: str = "exp_smooth",
) -> DataFrame:
    """Trend and season, additive or multiplicative, over several periods; the lowest criterion wins at every origin.

    Candidates that cannot be fitted (too short, or non-positive values with a multiplicative part) are skipped. `refine`
    rounds of halved steps lower the error of the candidate that the grid of weights chose.
    """
    make = SeasonalSearch(trends, seasons, periods, weights)
    return ordered_scan(df, target=target, horizon=horizon, make=make, name=name, keys=keys, date=date, refine=refine, detail=detail)
