"""Epsilon-insensitive kernel regression on random features (Rahimi and Recht 2007; Kar and Karnick 2012).

The kernel becomes a few dozen feature columns; the absolute loss outside the tube is solved by a few rounds of
reweighted least squares, each one a cross-product aggregation whose weights are a column of the last residual.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.backtest import contiguous_fold
from chronoloom.operators.frame import attach, whole, with_step
from chronoloom.operators.gram import KeyMoments, cross_products, fit, solve_per_key
from chronoloom.session import cut_lineage

# The search grid (the sigmoid kernel is not positive definite and has no random-feature form).
SVR_GRID = {"kernel": ["poly", "rbf"], "C": [0.1, 1.0, 10.0], "epsilon": [0.01, 1.0]}


def kernel_features(x: np.ndarray, kernel: str, dims: int, seed: int, degree: int = 3) -> np.ndarray:
    """Random features of the rows of `x` whose inner products approximate the kernel with gamma = 1 / (number of columns).

    Columns are scaled to unit variance, so that this is the usual "scale" width. A row with a missing value is all NaN.
    """
    rng, p = np.random.default_rng(seed), max(x.shape[1], 1)
    if kernel == "rbf":
        w = np.hstack([rng.normal(scale=np.sqrt(2.0 / p), size=(dims, p)), rng.uniform(0, 2 * np.pi, size=(dims, 1))])
        return np.cos(x @ w[:, :-1].T + w[:, -1]) * np.sqrt(2.0 / dims)
    if kernel == "poly":  # (gamma x.z)^degree as products of random signs
        signs = rng.choice([-1.0, 1.0], size=(dims, degree, p)) / np.sqrt(p)
        return np.prod([x @ signs[:, i].T for i in range(degree)], axis=0) * np.sqrt(1.0 / dims)
    if kernel == "linear":
        return x
    raise ValueError(f"kernel {kernel!r} is not offered")


def with_kernels(rows: DataFrame, columns: Sequence[str], kernels: Sequence[str], dims: int, seed: int) -> DataFrame:
    """`rows` with `phi_<kernel>` arrays (NaN where a column is missing) instead of `columns`, one product per Arrow batch."""
    kept = [c for c in rows.columns if c not in columns]
    rows = rows.select(*kept, F.array(*[F.col(c) for c in columns]).alias("__x"))
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(f"phi_{k}", T.ArrayType(T.DoubleType())) for k in kernels]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(columns))
            missing = ~np.isfinite(x).all(axis=1)
            out = []
            for k in kernels:
                phi = np.where(missing[:, None], np.nan, kernel_features(np.where(missing[:, None], 0.0, x), k, dims, seed))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * phi.shape[1])
                out.append(pa.ListArray.from_arrays(offsets, pa.array(phi.ravel())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *out], names=[*kept, *(f"phi_{k}" for k in kernels)])

    return rows.mapInArrow(run, schema)


def _weighted_fit(m: KeyMoments) -> pd.DataFrame:
    out = []
    if m.width:
        gram = m.total()
        if gram[0, 0] > 0:
            b0, beta, used = fit(gram, list(range(2, m.width)), 1.0)
            out.append((m.plain(b0, beta, used).tolist(),))
    return pd.DataFrame(out, columns=["coef"])


def _origins(name: str):
    def run(m: KeyMoments) -> pd.DataFrame:
        out = []
        gram = m.total() if m.width else None
        weights = m.rows[:, -1] if len(m.steps) else []
        width = m.width - 1
        for i, step in enumerate(m.steps):
            z, pred = m.rows[i][:width], np.nan
            if gram[0, 0] > 0:
                b0, beta, used = fit(gram[:width, :width], list(range(2, width)), 1.0)
                pred = b0 + (z[used] @ beta if used else 0.0)
            out.append((int(step), m.dates[i], name, None if not np.isfinite(pred) else float(pred)))
            if np.isfinite(z).all() and np.isfinite(weights[i]):
                grown = np.append(z, weights[i]) * np.sqrt(weights[i])
                gram = gram + np.outer(grown, grown)
        return pd.DataFrame(out, columns=["step", "date", "model", "pred"])

    return run


def _dot(z: str, coef: str) -> Column:
    return F.aggregate(F.zip_with(z, coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _prepare(df, target, features, horizon, keys, date, kernels, dims, seed) -> DataFrame:
    """Rows with `y`, `step`, positions and one random-feature array `phi_<kernel>` per kernel."""
    base = df.select(*keys, date, F.col(target).cast("double").alias("__y"), *features)
    base = with_step(base, keys, horizon, date)
    w0 = whole(keys)
    core = F.col("step").isNull()
    scaled = {}
    for i, c in enumerate(features):
        v = F.when(core, F.col(c).cast("double"))
        # a column that is constant in training carries nothing
        scaled[f"__x{i}"] = F.when(F.col(c).isNotNull(), F.coalesce(
            F.try_divide(F.col(c).cast("double") - F.avg(v).over(w0), F.stddev_pop(v).over(w0)), F.lit(0.0)))
    base = base.withColumns(scaled).withColumn("__mid", F.avg(F.when(core, F.col("__y"))).over(w0))
    return with_kernels(base, list(scaled), kernels, dims, seed)


def _rounds(rows: DataFrame, ids: Sequence[str], date: str, width: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Reweighting: rows with the last weights `__w` and shifted targets `__ys`, and rows with the final `__fit`.

    `rows` has `phi`, `y`, `__mid`, `C`, `epsilon`, `__train` and is read again in every round: only coefficients pass
    from one round to the next, so the plan grows by the same piece each time. A row outside the tube gets weight
    C / (|r| - eps) and a target moved by eps towards the fit; a row inside has no loss and keeps only a vanishing weight.
    """

    def fitted(coefs: DataFrame | None) -> DataFrame:
        if coefs is None:
            return rows.withColumn("__fit", F.col("__mid"))
        z = F.concat(F.array(F.lit(1.0), F.lit(0.0)), F.col("phi"))
        known = attach(rows, coefs, ids, "left").withColumn("__z", z)
        return known.withColumn("__fit", F.coalesce(_dot("__z", "coef"), F.col("__mid"))).drop("__z", "coef")

    def weighted(state: DataFrame) -> DataFrame:
        r = F.col("__y") - F.col("__fit")
        over = F.abs(r) - F.col("epsilon")
        floor = F.greatest(F.lit(1e-3) * F.col("__spread"), F.lit(1e-9))
        idle = 1e-6 * F.col("C") / F.greatest(F.col("__spread"), F.lit(1e-9))
        weight = F.when(over > 0, F.col("C") / F.greatest(over, floor)).otherwise(idle)
        moved = F.when(over > 0, F.col("__y") - F.signum(r) * F.col("epsilon")).otherwise(F.col("__fit"))
        return state.withColumns({"__w": weight, "__ys": moved})

    coefs, last = None, weighted(fitted(None))
    for _ in range(rounds):
        last = weighted(fitted(coefs))
        design = F.concat(F.array(F.lit(1.0), F.col("__ys")), F.col("phi"))
        parts = cross_products(last.filter(F.col("__train")), design, width=2 + width, keys=ids, date=date, weight=F.col("__w"))
        coefs = solve_per_key(parts, ids, _weighted_fit, "coef array<double>", carried=0)
    return last, fitted(coefs)


def svr_forecasts(
    df: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    kernel: str = "rbf",
    C: float = 1.0,
    epsilon: float = 0.1,
    params: DataFrame | None = None,
    dims: int = 48,
    rounds: int = 5,
    seed: int = 7,
    name: str = "svr",
) -> DataFrame:
    """Weights come from the rows before the first origin; every origin then refits on all complete rows before it.

    `params` (from `svr_search`) holds kernel, C and epsilon per key.
    """
    kernels = [kernel] if params is None else SVR_GRID["kernel"]
    rows = _prepare(df, target, features, horizon, keys, date, kernels, dims, seed)
    if params is not None:
        rows = attach(rows, params.select(*keys, "kernel", "C", "epsilon"), keys)
        phi = F.when(F.col("kernel") == "poly", F.col("phi_poly")).otherwise(F.col("phi_rbf"))
    else:
        rows = rows.withColumns({"C": F.lit(float(C)), "epsilon": F.lit(float(epsilon))})
        phi = F.col(f"phi_{kernel}")
    spread = F.stddev_pop(F.when(F.col("step").isNull(), F.col("__y"))).over(whole(keys))
    rows = rows.withColumns({"phi": phi, "__spread": spread, "__train": F.col("step").isNull()})
    rows = rows.select(*keys, date, "step", "__y", "phi", "__mid", "__spread", "C", "epsilon", "__train")
    rows = cut_lineage(rows)
    width = len(features) if kernel == "linear" and params is None else dims
    state, _ = _rounds(rows, keys, date, width, rounds)
    z = F.concat(F.array(F.lit(1.0), F.col("__ys")), F.col("phi"), F.array("__w"))
    parts = cross_products(state, z, width=3 + width, keys=keys, date=date, step="step", weight=F.col("__w"))
    return solve_per_key(parts, keys, _origins(name), "step int, date date, model string, pred double", carried=1)


def svr_search(
    df: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    grid: Mapping[str, Sequence] = SVR_GRID,
    folds: int = 3,
    tune_on: str = "newest",
    dims: int = 48,
    rounds: int = 3,
    seed: int = 7,
) -> DataFrame:
    """(keys, kernel, C, epsilon) with the lowest mean squared error over contiguous folds. Every (candidate, held
    fold) is an extra key of the same reweighting job."""
    rows = _prepare(df, target, features, horizon, keys, date, grid["kernel"], dims, seed)
    full = F.col("__y").isNotNull() & ~F.isnan(F.element_at(f"phi_{grid['kernel'][0]}", 1))
    member = full & (F.col("__row") < F.col("__rows") if tune_on == "newest" else F.col("step").isNull())
    rows = rows.withColumn("__fold", contiguous_fold(member, folds, keys, date)).filter(F.col("__fold").isNotNull())
    spread = F.stddev_pop("__y").over(whole(keys))
    rows = cut_lineage(rows.withColumn("__spread", spread))
    trials = []
    for i, (k, c, e) in enumerate(product(grid["kernel"], grid["C"], grid["epsilon"])):
        trials.append(F.struct(F.lit(i).alias("candidate"), F.lit(k).alias("kernel"), F.lit(float(c)).alias("C"),
                               F.lit(float(e)).alias("epsilon")))
    spread_out = rows.select("*", F.explode(F.array(*trials)).alias("c")).select(
        *keys, date, "__y", "__mid", "__spread", "__fold", "c.*",
        *[f"phi_{k}" for k in grid["kernel"]],
        F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held"),
    )
    phi = F.col(f"phi_{grid['kernel'][-1]}")
    for k in grid["kernel"][:-1]:
        phi = F.when(F.col("kernel") == k, F.col(f"phi_{k}")).otherwise(phi)
    spread_out = spread_out.withColumns({"phi": phi, "__train": F.col("__fold") != F.col("held")})
    _, state = _rounds(spread_out, [*keys, "candidate", "held"], date, dims, rounds)
    tested = state.filter(F.col("__fold") == F.col("held"))
    mse = tested.groupBy(*keys, "candidate", "kernel", "C", "epsilon", "held").agg(
        F.avg((F.col("__y") - F.col("__fit")) ** 2).alias("mse")
    )
    mean = mse.groupBy(*keys, "candidate", "kernel", "C", "epsilon").agg(F.avg("mse").alias("mse"))
    best = mean.groupBy(*keys).agg(F.min_by(F.struct("kernel", "C", "epsilon"), F.struct("mse", "candidate")).alias("b"))
    return best.select(*keys, "b.*")
