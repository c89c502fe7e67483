"""The tables behind a run's charts: correlations, decompositions, autocorrelations, scatter data, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chronoloom.operators import diagnostics, metrics
from chronoloom.plans.run import RunResult
from chronoloom.plans.spec import RunSpec

# Calendar parts that exist at each bucket level.
DATE_PARTS = {"daily": ("Year", "Month", "Day"), "weekly": ("Year", "Week"), "monthly": ("Year", "Month")}


def report_tables(result: RunResult, spec: RunSpec, max_lag: int = 20) -> dict[str, DataFrame]:
    """Lazy tables by name; nothing runs until one of them is used."""
    keys, m, var = list(spec.prepare.keys), result.matrix, result.variable
    level, rep, feat = spec.prepare.aggr_time_level, spec.report, spec.features
    out: dict[str, DataFrame] = {}
    chosen = diagnostics.correlation_columns(
        m.columns, var, extra=rep.vars_to_add_heatmap, engineered=rep.feature_eng_vars, holidays=feat.add_holidays,
        date_parts=DATE_PARTS[level] if feat.add_date else (),
    )
    lagged = [c for c in diagnostics.correlation_columns(m.columns, var, lags=True) if c != "lag_order"]
    for name, cols in (("correlation", chosen), ("lag_correlation", lagged)):
        if len(cols) > 1:
            out[name] = diagnostics.varying(diagnostics.correlation_matrix(m, cols, keys))
    for v in dict.fromkeys((spec.extract.prediction_column, "difference", "secdifference")):
        if v in m.columns:
            out[f"decomposition_{v}"] = diagnostics.decompose(m, v, level, keys)
            out[f"rolling_{v}"] = diagnostics.rolling_stats(m, v, keys)
    out["autocorrelation"] = diagnostics.autocorrelation(m, var, max_lag, keys)
    out["partial_autocorrelation"] = diagnostics.partial_autocorrelation(m, var, max_lag, keys)
    for x, y in rep.vars_to_plot_scatter:
        out[f"scatter_{x}_{y}"] = diagnostics.scatter_points(m, x, y, keys)
        out[f"binned_{x}_{y}"] = diagnostics.binned_counts(m, x, y, keys)
    if "difference" in m.columns:
        out["difference_evolution"] = diagnostics.difference_evolution(m, keys)
    out["metric_bars"] = metrics.metric_rows(result.metrics.select(*keys, "model", *metrics.METRICS), keys)
    out["selected_models"] = diagnostics.value_counts(result.selection, "model", keys)
    out["non_baseline_share"] = metrics.non_baseline_share(result.selection, result.models["baseline"], keys)
    return out
