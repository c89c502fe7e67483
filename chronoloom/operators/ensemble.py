"""Combining forecasts: family averages, stacked averages and the recent-performance selector.

Input is long: (keys, step, date, family, model, ord, pred, y). `ord` is the declared model order, which breaks ties.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Output names of the ensembles by family, and the order in which candidates are declared.
AVERAGES = {"ts": "ts_avg", "tabular": "tab_avg", "baseline": "bsln_avg"}
STACKS = {"baseline": "bsln_wavg", "ts": "ts_wavg", "tabular": "tab_wavg"}
FAMILY_ORDER = ("ts", "tabular", "baseline")
ENSEMBLE = "ensemble"
NEARLY_EQUAL = 1e-8


def label(preds: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds `family` and `ord` from the declared model lists; other models are dropped."""
    fam, order, i = [], [], 0
    for family in [f for f in FAMILY_ORDER if f in families] + [f for f in families if f not in FAMILY_ORDER]:
        for model in families[family]:
            fam += [F.lit(model), F.lit(family)]
            order += [F.lit(model), F.lit(i)]
            i += 1
    out = preds.withColumns({"family": F.create_map(*fam)[F.col("model")], "ord": F.create_map(*order)[F.col("model")]})
    return out.filter(F.col("family").isNotNull())


def family_averages(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean forecast of every family at every step; missing forecasts are skipped."""
    names = F.create_map(*[F.lit(x) for kv in AVERAGES.items() for x in kv])
    places = F.create_map(*[F.lit(x) for i, f in enumerate(AVERAGES) for x in (f, 1000 + i)])
    mean = preds.groupBy(*keys, "step", "date", "family").agg(F.avg("pred").alias("pred"), F.first("y").alias("y"))
    return mean.select(
        *keys,
        "step",
        "date",
        F.lit(ENSEMBLE).alias("family"),
        names[F.col("family")].alias("model"),
        places[F.col("family")].alias("ord"),
        "pred",
        "y",
    )


def _stack(warmup_share: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step").reset_index(drop=True)
        x = np.vstack([np.asarray(v, dtype=float) for v in pdf["preds"]])
        x = x[:, np.isfinite(x).any(axis=0)]
        y = pdf["y"].to_numpy(dtype=float)
        warm = x.shape[1] + int(len(x) * warmup_share)
        out = []
        for i in range(len(x)):
            row = x[i][np.isfinite(x[i])]
            pred = row.mean() if row.size else np.nan
            if i >= warm and np.isfinite(x[i]).all():
                ok = np.isfinite(x[:i]).all(axis=1) & np.isfinite(y[:i])
                if ok.any():
                    xs, ys = x[:i][ok], y[:i][ok]
                    mx, my = xs.mean(axis=0), ys.mean()
                    size = np.where((xs - mx).any(axis=0), np.linalg.norm(xs - mx, axis=0), 1.0)
                    # forecasts that agree to rounding count as one, or their difference would be amplified
                    beta = np.linalg.lstsq((xs - mx) / size, ys - my, rcond=NEARLY_EQUAL)[0]
                    pred = my + (x[i] - mx) / size @ beta
            out.append(pred)
        res = pdf.drop(columns=["preds"])
        res["pred"] = pd.Series(out, dtype=float).where(np.isfinite(out), None)
        return res

    return run


def stacked_averages(preds: DataFrame, keys: Sequence[str] = (), warmup_share: float = 0.15) -> DataFrame:
    """Per family: plain mean for the first (models + int(share * steps)) steps, then least squares of the truth on
    the family's forecasts over all earlier steps.

    A group is one family of one key: as many rows as there are backtest steps, whatever the series length.
    """
    keys = list(keys)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "pred")))
    rows = preds.groupBy(*keys, "family", "step", "date").agg(
        F.transform(ordered, lambda s: s["pred"]).alias("preds"), F.first("y").alias("y")
    )
    schema = T.StructType(
        [rows.schema[c] for c in [*keys, "family", "step", "date", "y"]] + [T.StructField("pred", T.DoubleType())]
    )
    solved = rows.groupBy(*keys, "family").applyInPandas(_stack(warmup_share), schema)
    names = F.create_map(*[F.lit(x) for kv in STACKS.items() for x in kv])
    places = F.create_map(*[F.lit(x) for i, f in enumerate(STACKS) for x in (f, 1010 + i)])
    return solved.select(
        *keys,
        "step",
        "date",
        F.lit(ENSEMBLE).alias("family"),
        names[F.col("family")].alias("model"),
        places[F.col("family")].alias("ord"),
        "pred",
        "y",
    )


def select_model(
    preds: DataFrame,
    *,
    min_steps: int,
    keys: Sequence[str] = (),
    ignore_models: Sequence[str] = (),
    exclude_families: Sequence[str] = (),
) -> DataFrame:
    """From step `min_steps` on: the forecast of the model with the lowest mean absolute error over the previous
    `min_steps` steps. Ties go to the model declared first. (keys, step, date, y, model, pred, window_mae)."""
    pool = preds
    if ignore_models:
        pool = pool.filter(~F.col("model").isin(list(ignore_models)))
    if exclude_families:
        pool = pool.filter(~F.col("family").isin(list(exclude_families)))
    if keys:  # a key has horizon x models rows; this one exchange serves both the window and the aggregate
        pool = pool.repartition(*keys)
    past = Window.partitionBy(*keys, "model").orderBy("step").rowsBetween(-min_steps, -1)
    scored = pool.withColumn("window_mae", F.avg(F.abs(F.col("pred") - F.col("y"))).over(past))
    scored = scored.filter((F.col("step") >= min_steps) & F.col("window_mae").isNotNull())
    best = F.min_by(F.struct("model", "pred", "window_mae"), F.struct("window_mae", "ord"))
    return (
        scored.groupBy(*keys, "step", "date")
        .agg(F.first("y").alias("y"), best.alias("b"))
        .select(*keys, "step", "date", "y", "b.model", "b.pred", "b.window_mae")
    )


def best_model_per_key(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, model, mae): the model with the lowest mean absolute error over all steps of a key."""
    mae = preds.groupBy(*keys, "model", "ord").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))
    best = F.min_by(F.struct("model", "mae"), F.when(F.col("mae").isNotNull(), F.struct("mae", "ord")))
    return mae.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.model", "b.mae")


def mean_error_of_models(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the models of each model's mean absolute error."""
    mae = preds.groupBy(*keys, "model").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))
    return mae.groupBy(*keys).agg(F.avg("mae").alias("mean_mae"))


def closest_to_zero(df: DataFrame, cols: Sequence[str], name: str = "closest") -> DataFrame:
    """Per row, the value nearest to zero among `cols` (the first one on ties); nulls are skipped."""
    cells = F.filter(F.array(*[F.col(c) for c in cols]), lambda v: v.isNotNull())
    pick = F.aggregate(cells, F.get(cells, 0), lambda best, v: F.when(F.abs(v) < F.abs(best), v).otherwise(best))
    return df.withColumn(name, pick)
