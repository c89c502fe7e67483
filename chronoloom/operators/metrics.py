"""Error metrics, the comparison table and its conclusions, from long predictions (keys, step, model, pred, y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.columns import huber, pinball

# Row labels of the error table, in order, and the summary's row titles.
METRICS = ("Rms", "Mae", "Mdn", "Mp", "Hbb", "Q25", "Q75", "Me")
SUMMARY_TITLES = {
    "baseline": "Best baseline model",
    "ts": "Best time series model",
    "tabular": "Best tabular model",
    "selector": "Specifc model",
}
SELECTOR = "mdl_slct_pred"


def metric_columns(pred: str = "pred", y: str = "y") -> dict[str, Column]:
    p, t = F.col(pred), F.col(y)
    e = t - p
    return {
        "Rms": F.sqrt(F.avg(e * e)),
        "Mae": F.avg(F.abs(e)),
        "Mdn": F.percentile(F.abs(e), F.lit(0.5)),
        "Mp": F.avg(F.abs(F.try_divide(e, t))) * 100,
        "Hbb": F.avg(huber(e)),
        "Q25": F.avg(pinball(e, 0.25)),
        "Q75": F.avg(pinball(e, 0.75)),
        "Me": F.avg(p - t),
    }


def metric_table(preds: DataFrame, keys: Sequence[str] = (), by: Sequence[str] = ("model",)) -> DataFrame:
    """All eight metrics per (keys, model) in one aggregate. A zero actual is left out of `Mp`."""
    return preds.groupBy(*keys, *by).agg(*[c.alias(n) for n, c in metric_columns().items()])


def metric_rows(table: DataFrame, keys: Sequence[str] = (), by: Sequence[str] = ("model",)) -> DataFrame:
    """Long form (keys, model, metric, value), which is also the data of the per-metric bar charts."""
    return table.unpivot([*keys, *by], list(METRICS), "metric", "value")


def metric_matrix(table: DataFrame, models: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per metric and one column per model, under the header `Metric`."""
    long = metric_rows(table.select(*keys, "model", *METRICS), keys).withColumnRenamed("metric", "Metric")
    return long.groupBy(*keys, "Metric").pivot("model", list(models)).agg(F.first("value"))


def adjusted_r2(preds: DataFrame, regressors: int, keys: Sequence[str] = (), by: Sequence[str] = ("model",)) -> DataFrame:
    """1 - (1 - R2)(n - 1)/(n - k - 1)."""
    e = F.col("y") - F.col("pred")
    ok = F.col("y").isNotNull() & F.col("pred").isNotNull()
    sums = preds.filter(ok).groupBy(*keys, *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count(F.lit(1))).alias("sst")
    )
    r2 = 1 - F.try_divide("sse", "sst")
    adjusted = 1 - (1 - r2) * F.try_divide(F.col("n") - 1, F.col("n") - regressors - 1)
    return sums.select(*keys, *by, adjusted.alias("adj_r2"))


def non_baseline_share(selection: DataFrame, baselines: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Percentage of steps at which the selector took something other than a baseline."""
    hit = F.when(F.col("model").isin(list(baselines)), F.lit(0.0)).otherwise(F.lit(1.0))
    return selection.groupBy(*keys).agg((F.avg(hit) * 100).alias("non_baseline_pct"))


def summary(
    table: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] = ("Mae", "Mp"), order: str = "ord"
) -> DataFrame:
    """(keys, metric, family, model, value): the best model of every family by each metric.

    `table` is a metric table with `family` and a declared model order, which decides ties.
    """
    long = table.unpivot([*keys, "family", "model", order], list(metrics), "metric", "value")
    rank = F.when(F.col("value").isNotNull(), F.struct("value", order))
    best = long.groupBy(*keys, "metric", "family").agg(
        F.min_by("model", rank).alias("model"), F.min("value").alias("value")
    )
    return best


def summary_view(best: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The summary under its report headers: MAE rows first, then MAPE rows, both in the column `MAE`."""
    title = F.create_map(*[F.lit(x) for kv in SUMMARY_TITLES.items() for x in kv])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(SUMMARY_TITLES) for x in (k, i)])
    rows = best.filter(F.col("family").isin(list(SUMMARY_TITLES)))
    return rows.orderBy(*keys, "metric", place[F.col("family")]).select(
        *keys,
        title[F.col("family")].alias("Type of approach"),
        F.col("model").alias("Model"),
        F.col("value").alias("MAE"),
    )
