"""Cross-product ("Gram") aggregation, the one operator behind every regression in the engine.

Design rows are columns `z = [1, y, x1..xp]`. Each task sums z'z over its own Arrow batches per (keys, block), so a
hot key costs its tasks one small matrix each, and only those matrices and the few rows flagged as origins are
shuffled. A solver then sees, per key, the summed matrices and the origin rows: its input does not grow with the
length of the series.

A task sums products of what its rows differ from its own mean row by, and sends that row along; the parts are moved to one
common origin when they are added. So a column at 10^9 that varies by 1 keeps its digits, whoever asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.frame import spread


def _summed(keys: list[str], width: int):
    """Batch function: sums complete core rows per (keys, block), upper triangle only; passes origin rows through."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            z = batch.column("__z").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, width)
            step = batch.column("step").to_pandas()
            group_cols = [*keys, "__block"]
            labels = pd.DataFrame({c: batch.column(c).to_pandas() for c in group_cols})
            core = step.isna().to_numpy() & np.isfinite(z).all(axis=1)
            first, count, payload = [], [], []
            at = np.flatnonzero(core)
            if at.size:
                codes = labels.iloc[at].groupby(group_cols, sort=False, dropna=False).ngroup().to_numpy()
                order = np.argsort(codes, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0, True])
                for lo, hi in zip(edges[:-1], edges[1:]):
                    members = at[order[lo:hi]]
                    part = z[members]
                    first.append(members[0])
                    count.append(len(members))
                    mass = part[:, 0] @ part[:, 0]  # rows, or their weights
                    middle = (part[:, 0] @ part) / mass if mass > 0 else np.zeros(width)
                    middle[:2] = 0.0
                    part = part - np.outer(part[:, 0], middle)
                    payload.append(np.concatenate([middle, (part.T @ part)[upper]]))
            origin = np.flatnonzero(step.notna().to_numpy())
            for i in origin:
                first.append(i)
                count.append(1)
                payload.append(z[i])
            if not first:
                continue
            idx = pa.array(np.asarray(first, dtype=np.int64))
            offsets = np.r_[0, np.cumsum([len(p) for p in payload])].astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(payload)))
            arrays = [batch.column(c).take(idx) for c in [*keys, "__block", "step", "date"]]
            names = [*keys, "__block", "step", "date", "__count", "__payload"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(count, pa.int64()), flat], names=names)

    return run


def cross_products(
    df: DataFrame,
    z: Sequence[str | Column] | Column,
    *,
    keys: Sequence[str] = (),
    date: str = "date",
    step: str | Column | None = None,
    block: str | Column | None = None,
    weight: Column | None = None,
    width: int | None = None,
) -> DataFrame:
    """(keys, block, step, date, rows, payload): partial z'z where step is NULL (the mean of the regressors, then the packed
    upper triangle of the products about it), the row z itself elsewhere.

    `z` is a list of columns, or one array column of `width` doubles (wide designs: it keeps generated code small).
    Core rows with any missing value are left out; origin rows keep theirs as NaN. `weight` scales a core row's
    contribution.
    """
    keys = list(keys)
    if isinstance(z, Column):
        row, size = z, width
    else:
        row = F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in z])
        size = len(z)
    step_col = F.lit(None).cast("int") if step is None else (F.col(step) if isinstance(step, str) else step)
    block_col = F.lit(0) if block is None else (F.col(block) if isinstance(block, str) else block)
    if weight is not None:
        root = F.when(step_col.isNull(), F.sqrt(weight)).otherwise(F.lit(1.0))
        row = F.transform(row, lambda v: v * root)
    rows = df.select(
        *keys,
        F.coalesce(block_col, F.lit(0)).cast("int").alias("__block"),
        step_col.cast("int").alias("step"),
        F.col(date).alias("date"),
        row.alias("__z"),
    )
    fields = [f for f in rows.schema.fields if f.name != "__z"]
    schema = T.StructType(
        [*fields, T.StructField("__count", T.LongType()), T.StructField("__payload", T.ArrayType(T.DoubleType()))]
    )
    return rows.mapInArrow(_summed(keys, size), schema)


class KeyMoments:
    """What a solver gets for one key: z'z and row count per block, and the origin rows by step.

    With `carried` given, the regressors (all columns but the first two and the `carried` last ones) are counted from
    `shift`, their mean over the summed rows, in the matrices and in the origin rows alike: slopes and forecasts are the same,
    and an intercept for rows as they came is `plain(..)`. Without it all is as it came.
    """

    def __init__(self, pdf: pd.DataFrame, carried: int | None = None):
        core = pdf[pdf["step"].isna()]
        own = pdf[pdf["step"].notna()].sort_values("step")
        self.steps = own["step"].astype(int).to_numpy()
        self.dates = own["date"].to_numpy()
        self.blocks = own["__block"].astype(int).to_numpy()
        self.rows = np.vstack(own["__payload"].to_numpy()) if len(own) else np.zeros((0, 0))
        if len(own):
            width = self.rows.shape[1]
        elif len(core):
            width = int(round(((8 * len(core["__payload"].iloc[0]) + 9) ** 0.5 - 3) / 2))
        else:
            width = 0
        self.width = width
        self.gram: dict[int, np.ndarray] = {}
        self.count: dict[int, int] = {}
        packed = [np.asarray(p, dtype=float) for p in core["__payload"]]
        self.shift = np.zeros(width)
        if carried is not None and packed:
            mass = np.array([p[width] for p in packed])
            if mass.sum() > 0:
                self.shift = mass @ np.stack([p[:width] for p in packed]) / mass.sum()
            self.shift[width - carried :] = 0.0
            if len(own):
                self.rows = self.rows - np.outer(self.rows[:, 0], self.shift)
        for b, k, p in zip(core["__block"], core["__count"], packed):
            b = int(b)
            g = np.zeros((width, width))
            g[np.triu_indices(width)] = p[width:]
            g = g + np.triu(g, 1).T
            moved = np.eye(width)
            moved[:, 0] += p[:width] - self.shift
            self.gram[b] = self.gram.get(b, 0) + moved @ g @ moved.T
            self.count[b] = self.count.get(b, 0) + int(k)

    def plain(self, intercept: float, beta: np.ndarray, used: Sequence[int]) -> np.ndarray:
        """Coefficients for rows as they came: the intercept at 0, slopes at `used`."""
        full = np.zeros(self.width)
        full[0] = intercept - (self.shift[list(used)] @ beta if len(used) else 0.0)
        full[list(used)] = beta
        return full

    def total(self) -> np.ndarray:
        out = np.zeros((self.width, self.width))
        for g in self.gram.values():
            out = out + g
        return out

    def complete(self, i: int, cols: Sequence[int] | None = None) -> bool:
        row = self.rows[i] if cols is None else self.rows[i][list(cols)]
        return bool(np.isfinite(row).all())


def solve_per_key(
    parts: DataFrame, keys: Sequence[str], fn: Callable[[KeyMoments], pd.DataFrame], out: str | T.StructType, carried: int | None = None
) -> DataFrame:
    """Runs `fn` on the summed cells of each key; `out` is the DDL of the columns `fn` returns. `carried`: see KeyMoments.

    The cells are few bytes but much work, so they are spread over the configured number of shuffle partitions rather
    than left to be coalesced by size.
    """
    keys = list(keys)
    names = [f.name for f in (T._parse_datatype_string(out) if isinstance(out, str) else out).fields]
    out_fields = (T._parse_datatype_string(out) if isinstance(out, str) else out).fields
    schema = T.StructType([parts.schema[k] for k in keys] + list(out_fields))

    def per_key(pdf: pd.DataFrame) -> pd.DataFrame:
        res = fn(KeyMoments(pdf, carried))
        for k in reversed(keys):
            res.insert(0, k, pd.Series([pdf[k].iloc[0]] * len(res), dtype=pdf[k].dtype))  # typed, also without rows
        return res[[*keys, *names]]

    return spread(parts, keys).groupBy(*keys).applyInPandas(per_key, schema)


# --- numpy on already aggregated cells -------------------------------------------------------------------------

CONSTANT = 1e-11  # variance below this share of the second moment counts as a constant column
RANK = 1e-11  # eigenvalues of the correlation matrix below this share are rank deficiency


def centred(gram: np.ndarray, xs: Sequence[int]) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """(n, x mean, y mean, Sxx, Sxy, Syy) from z'z with z = [1, y, x..]; xs are z positions."""
    n = gram[0, 0]
    xs = list(xs)
    mx, my = gram[0, xs] / n, gram[0, 1] / n
    sxx = gram[np.ix_(xs, xs)] - n * np.outer(mx, mx)
    sxy = gram[xs, 1] - n * mx * my
    syy = gram[1, 1] - n * my * my
    return n, mx, my, sxx, sxy, max(syy, 0.0)


def varying_columns(gram: np.ndarray, xs: Sequence[int]) -> list[int]:
    """Positions whose column is not constant in the summed rows."""
    n = gram[0, 0]
    keep = []
    for i in xs:
        second = gram[i, i]
        if n > 1 and second - gram[0, i] ** 2 / n > CONSTANT * max(second, 1e-300):
            keep.append(i)
    return keep


def least_squares(sxx: np.ndarray, sxy: np.ndarray, penalty: np.ndarray | float = 0.0) -> np.ndarray:
    """Minimum-norm solution on scaled columns; `penalty` is added to the diagonal before scaling."""
    if not len(sxy):
        return np.zeros(0)
    a = sxx + np.diag(np.broadcast_to(np.asarray(penalty, dtype=float), (len(sxy),)))
    d = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    vals, vecs = np.linalg.eigh(a / np.outer(d, d))
    keep = vals > RANK * max(vals[-1], 1e-300)
    inv = vecs[:, keep] / vals[keep]
    return (inv @ (vecs[:, keep].T @ (sxy / d))) / d


def fit(gram: np.ndarray, xs: Sequence[int], penalty: np.ndarray | float = 0.0) -> tuple[float, np.ndarray, list[int]]:
    """(intercept, coefficients, used positions) of a linear fit with an unpenalised intercept."""
    used = varying_columns(gram, xs)
    n, mx, my, sxx, sxy, _ = centred(gram, used) if used else (gram[0, 0], np.zeros(0), gram[0, 1] / gram[0, 0], None, None, 0)
    if not used:
        return float(my), np.zeros(0), []
    pen = np.asarray(penalty, dtype=float)
    if pen.ndim:
        pen = pen[[list(xs).index(i) for i in used]]
    beta = least_squares(sxx, sxy, pen)
    return float(my - mx @ beta), beta, used


def residual_sum(gram: np.ndarray, intercept: float, beta: np.ndarray, used: Sequence[int]) -> float:
    """Sum of squared residuals of given coefficients over the rows summed in `gram`."""
    v = np.zeros(gram.shape[0])
    v[0], v[1] = -intercept, 1.0
    v[list(used)] = -beta
    return float(max(v @ gram @ v, 0.0))


def gaussian_criterion(sse: float, n: float, k: int, kind: str = "AIC") -> float:
    """Information criterion of a Gaussian fit with k parameters."""
    if n <= k or sse <= 0 or not np.isfinite(sse):
        return np.inf if n <= k or not np.isfinite(sse) else -np.inf
    llf = -0.5 * n * (np.log(2 * np.pi * sse / n) + 1)
    if kind == "BIC":
        return -2 * llf + k * np.log(n)
    if kind == "HQIC":
        return -2 * llf + 2 * k * np.log(np.log(n))
    return -2 * llf + 2 * k
