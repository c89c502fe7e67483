"""One run, end to end. Two lineage cuts: after the model matrix, and after the forecasts.

Everything before the first cut is one lazy chain. The forecasters all read the same matrix; ensembles, selection and
metrics all read the same forecasts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.columns import parse_date, parse_short_year_month, parse_timestamp_day
from chronoloom.models.additive import additive_forecasts, additive_search, best_additive, params_grid
from chronoloom.models.arima import arima_forecasts, difference_orders
from chronoloom.models.baseline import BASELINES, baseline_forecasts
from chronoloom.models.harmonic import power_harmonic_forecasts
from chronoloom.models.knn import KNN_GRID, knn_forecasts, knn_search
from chronoloom.models.linear import LINEAR_MODELS, linear_forecasts
from chronoloom.models.smoothing import holt_forecasts, seasonal_forecasts
from chronoloom.models.svr import SVR_GRID, svr_forecasts, svr_search
from chronoloom.models.trees import tree_forecasts
from chronoloom.operators import ensemble, metrics
from chronoloom.operators.backtest import actuals, undo_differences
from chronoloom.operators.features import add_calendar_parts, add_trailing, feature_columns
from chronoloom.operators.frame import attach, join_keys
from chronoloom.operators.holidays import add_holidays, holiday_calendar, years_of
from chronoloom.operators.missing import repair
from chronoloom.operators.scaling import apply_scaler, fit_scaler, invert_scaler
from chronoloom.operators.stationarity import (
    choose_difference,
    choose_lag_order,
    default_test_lags,
    drop_leading,
    longest_series,
)
from chronoloom.operators.timegrid import bucket_aggregate, fill_calendar
from chronoloom.operators.transforms import (
    cut_extremes,
    differences,
    divide_columns,
    lag_block,
    lag_block_by_order,
    shift_columns,
)
from chronoloom.plans.spec import ModelSpec, RunSpec, additive_params
from chronoloom.session import cut_lineage
from chronoloom.sources.cleaning import coerce_numeric, drop_header_rows, fix_numbers, prune_columns
from chronoloom.sources.readers import EXTENSIONS, SOURCE_KINDS, SourceSpec, read_source
from chronoloom.sources.sinks import result_name, write_results

# Model names of the two larger families in declared order.
TS_MODELS = ("arima_diff", "arima_eda", "tbats", "exp_smooth", "holt", "prophet")
TS_EXOGENOUS = ("arima_exo_diff", "arima_exo_eda", "prophet_exo")
# Rounds in which the weights of exponential smoothing move on from the best point of their grid.
SMOOTHING_ROUNDS = 3
TABULAR_MODELS = ("linear", "rf", "svr", "lasso", "ridge", "elastic", "xgb", "knn")
WORK_NAMES = ("", "difference", "secdifference")


@dataclass
class RunResult:
    series: DataFrame
    orders: DataFrame
    lag_orders: DataFrame | None
    matrix: DataFrame
    forecasts: DataFrame
    selection: DataFrame
    metrics: DataFrame
    summary: DataFrame
    variable: str
    models: dict = field(default_factory=dict)
    notes: list = field(default_factory=list)  # settings of the specification that this engine can't follow


def extract(spark: SparkSession, spec: RunSpec, root: str = "") -> DataFrame:
    """Reads and repairs the source table named by the specification."""
    ex = spec.extract
    fmt = SOURCE_KINDS[ex.type_extraction][0]
    path = ex.path or f"{root.rstrip('/')}/{ex.name}{EXTENSIONS[fmt]}"
    return clean(read_source(spark, SourceSpec(ex.type_extraction, path, ex.excel_split)), spec)


def clean(df: DataFrame, spec: RunSpec) -> DataFrame:
    ex = spec.extract
    if ex.clean_columns_rows:
        df = drop_header_rows(df, ex.prediction_column)
    df = fix_numbers(df, ex.variable_issues)
    # only text columns the run will use as numbers are checked: for typed sources this costs no scan at all
    numbers = {ex.prediction_column, *spec.prepare.mean_columns, *spec.prepare.sum_columns}
    df = coerce_numeric(df, sorted(numbers - {ex.ts_column, *spec.prepare.keys}))
    return prune_columns(
        df, spec.mode, ts=ex.ts_column, target=ex.prediction_column, categoric=ex.categoric_numeric_columns,
        keys=spec.prepare.keys,
    )


def prepare_series(df: DataFrame, spec: RunSpec) -> DataFrame:
    """Raw rows -> regular series: dates, buckets, aggregation, edges, gaps, missing values, scaling, shifting."""
    ex, pre = spec.extract, spec.prepare
    keys, ts = list(pre.keys), ex.ts_column
    if pre.date_type == "0Y-0M":
        df = df.withColumn(ts, parse_short_year_month(ts, pre.year_pivot))
    elif pre.date_type == "Y-M-D H:M:S":
        df = df.withColumn(ts, parse_timestamp_day(ts))
    elif dict(df.dtypes)[ts] == "string":
        df = df.withColumn(ts, parse_date(ts, pre.date_type if any(c in pre.date_type for c in "yd") else None))
    means, sums = list(pre.mean_columns), list(pre.sum_columns)
    if spec.mode == "ts_only":
        means = [] if sums else means
    # Without bucketing, dates are still cut to days and a day may hold several rows: one row per key and day goes on,
    # so that the windows below stay bounded by the calendar; days without rows stay away.
    series = bucket_aggregate(
        df, ts=ts, level=pre.aggr_time_level if pre.aggr_time else "daily", keys=keys, means=means, sums=sums,
        firsts=pre.unique_columns if keys else (),
    )
    if pre.cut_extremes:
        series = cut_extremes(series, keys)
    if pre.aggr_time:
        series = fill_calendar(series, level=pre.aggr_time_level, keys=keys)
    series = repair(series, pre.deal_na, keys=keys, value=pre.substitute_na_value)
    series = divide_columns(series, pre.columns_to_divide_by_time, pre.number_to_divide_by_time)
    if spec.mode != "ts_only":
        series = shift_columns(series, pre.columns_to_shift, keys)
    return series


def choose_work(series: DataFrame, spec: RunSpec, max_test_lag: int) -> tuple[DataFrame, DataFrame, str]:
    """(series with differences and the working variable, orders per key, name of the working variable).

    A single series names its working variable after the chosen level. With keys the choice may differ per key, so
    the column is called `work`.
    """
    pre, target, keys = spec.prepare, spec.extract.prediction_column, list(spec.prepare.keys)
    df = differences(series, target, keys, order=pre.max_difference)
    orders = choose_difference(df, target, keys=keys, max_order=pre.max_difference, max_lag=max_test_lag)
    orders = cut_lineage(orders)
    shifted = spec.mode != "ts_only" and bool(pre.columns_to_shift)
    df = attach(df, orders.select(*keys, "diff_order"), keys)
    df = drop_leading(df, "diff_order", keys=keys, shifted=shifted)
    if not keys:
        k = orders.first()["diff_order"]
        return df, orders, WORK_NAMES[k] or target
    work = F.col(target)
    for k, name in enumerate(WORK_NAMES[1 : pre.max_difference + 1], 1):
        work = F.when(F.col("diff_order") == k, F.col(name)).otherwise(work)
    return df.withColumn("work", work), orders, "work"


def scale(df: DataFrame, spec: RunSpec, variable: str) -> tuple[DataFrame, DataFrame | None]:
    """Normalised frame and the fitted values of the working variable (None when it is not scaled)."""
    pre, keys = spec.prepare, list(spec.prepare.keys)
    keep = None
    if pre.fit_on == "train":
        back = F.row_number().over(_newest_first(keys))
        df = df.withColumn("__back", back)
        keep = F.col("__back") > spec.model.horizon
    stats = None
    if pre.normalize or pre.normalize_if_not_diff:
        stats = fit_scaler(df, [variable], pre.type_normalization, keys, keep)
        if pre.normalize_if_not_diff:  # only keys that stay on the level are scaled
            levels = df.groupBy(*keys).agg(F.min("diff_order").alias("diff_order"))
            stats = attach(stats, levels, keys)
            for part, neutral in (("loc", 0.0), ("scale", 1.0)):
                name = f"{variable}__{part}"
                stats = stats.withColumn(name, F.when(F.col("diff_order") == 0, F.col(name)).otherwise(F.lit(neutral)))
            stats = stats.drop("diff_order")
    exo_stats, exo = None, []
    if pre.normalize_independent_var:
        exo = feature_columns(df, target=variable, keys=keys, helpers=("diff_order", "__back"))
        if exo:
            exo_stats = fit_scaler(df, exo, pre.type_normalization, keys, keep)
    if stats is not None:
        stats = cut_lineage(stats)
        df = apply_scaler(df, stats, [variable], keys)
    if exo_stats is not None:
        df = apply_scaler(df, exo_stats, exo, keys)
    return df.drop("__back"), stats


def _newest_first(keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(F.col("date").desc())


def with_lag_order(df: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    return attach(df, orders, keys, "left").withColumn("lag_order", F.coalesce("lag_order", F.lit(1)))


def build_matrix(
    df: DataFrame, spec: RunSpec, variable: str, holidays: DataFrame | None
) -> tuple[DataFrame, DataFrame | None, int]:
    """Lags, holidays, calendar parts and trailing features. Returns (matrix, lag orders per key, longest order)."""
    keys, feat, lag = list(spec.prepare.keys), spec.features, spec.lags
    lagged = [variable] + ([v for v in lag.vars_to_lag] if spec.mode != "ts_only" else [])
    level = spec.prepare.aggr_time_level
    if lag.compute_lags:
        orders = cut_lineage(choose_lag_order(df, variable, lag.max_lags, criterion=lag.metric, keys=keys))
        longest = int(orders.agg(F.max("lag_order")).first()[0] or 1)
        df = with_lag_order(df, orders, keys)
        df = lag_block_by_order(df, lagged, longest, "lag_order", keys) if keys else lag_block(df, lagged, longest)
    else:
        orders, longest = None, int(lag.steps)
        df = lag_block(df, lagged, longest, keys).withColumn("lag_order", F.lit(longest))
    if feat.add_holidays and holidays is not None:
        df = add_holidays(df, holidays, level)
    if feat.add_date:
        df = add_calendar_parts(df, level)
    return (
        add_trailing(df, means=feat.mean_vars, medians=feat.median_vars, weighted=feat.mean_weighted_vars, keys=keys),
        orders,
        longest,
    )


def svr_grid(asked: dict) -> tuple[dict, list[str]]:
    """The support-vector grid to search, and what was asked for and can't be: other kernels, other entries.

    A grid without any kernel that can be searched raises.
    """
    grid = {**SVR_GRID, **{k: list(v) for k, v in asked.items() if k in SVR_GRID}}
    notes = [f"svr: grid entry {k!r} is not searched" for k in asked if k not in SVR_GRID]
    notes += [f"svr: kernel {k!r} has no random-feature form and is not searched" for k in grid["kernel"] if k not in ("poly", "rbf")]
    grid["kernel"] = [k for k in grid["kernel"] if k in ("poly", "rbf")]
    if not grid["kernel"]:
        raise ValueError("svr: none of the kernels of the grid can be searched")
    return grid, notes


def tabular_forecasts(matrix: DataFrame, variable: str, features: list[str], keys: list[str], m: ModelSpec) -> DataFrame:
    common = dict(target=variable, features=features, horizon=m.horizon, keys=keys)
    grid = m.elastic.grid if m.elastic.optimize else None
    elastic = (float(m.elastic.params.get("alpha", 1.0)), float(m.elastic.params.get("l1_ratio", 0.5)))
    linear = [x for x in LINEAR_MODELS if x not in m.skip]
    parts = []
    if linear:
        parts.append(
            linear_forecasts(
                matrix, models=linear, elastic_params=elastic, elastic_grid=grid, tune_on=m.tune_on, **common
            )
        )
    for kind, name, tuned in (("rf", "rf", m.rf), ("gbt", "xgb", m.xgb)):
        if name not in m.skip:
            parts.append(
                tree_forecasts(
                    matrix, kind=kind, params=tuned.params, grid=tuned.grid if tuned.optimize else None,
                    refit=m.tree_refit, tune_on=m.tune_on, **common,
                )
            )
    if "svr" not in m.skip:
        if m.svr.optimize:
            grid, _ = svr_grid(m.svr.grid)
            best = cut_lineage(svr_search(matrix, grid=grid, tune_on=m.tune_on, **common))
            parts.append(svr_forecasts(matrix, params=best, **common))
        else:
            parts.append(svr_forecasts(matrix, **m.svr.params, **common))
    if "knn" not in m.skip:
        if m.knn.optimize:
            grid = {**KNN_GRID, **m.knn.grid}
            best = cut_lineage(knn_search(matrix, grid=grid, tune_on=m.tune_on, **common))
            parts.append(knn_forecasts(matrix, params=best, max_k=max(grid["n_neighbors"]), **common))
        else:
            p = m.knn.params
            parts.append(knn_forecasts(matrix, k=int(p["n_neighbors"]), weights=p["weights"], p=int(p["p"]), **common))
    return _union(parts)


def ts_forecasts(
    matrix: DataFrame,
    variable: str,
    exogenous: list[str],
    keys: list[str],
    m: ModelSpec,
    mode: str,
    holidays: DataFrame | None,
    max_test_lag: int,
) -> DataFrame:
    common = dict(target=variable, horizon=m.horizon, keys=keys)
    free = {"arima_diff", "arima_exo_diff"} - set(m.skip)
    found = cut_lineage(difference_orders(matrix, max_test_lag=max_test_lag, **common)) if free else None
    orders = dict(max_p=m.max_p, max_q=m.max_q, stored=True, orders=found, method=m.arima_method)
    makers = {
        "arima_diff": lambda: arima_forecasts(matrix, name="arima_diff", **orders, **common),
        "arima_eda": lambda: arima_forecasts(matrix, d=0, name="arima_eda", **orders, **common),
        "tbats": lambda: power_harmonic_forecasts(matrix, periods=m.seasonal_periods, **common),
        "exp_smooth": lambda: seasonal_forecasts(matrix, refine=SMOOTHING_ROUNDS, **common),
        "holt": lambda: holt_forecasts(matrix, refine=SMOOTHING_ROUNDS, **common),
        "prophet": lambda: _additive(matrix, m, m.additive, holidays, [], "prophet", common),
    }
    if mode != "ts_only":
        no_flag = [c for c in exogenous if c != "holidays_fe" or holidays is None]
        makers |= {
            "arima_exo_diff": lambda: arima_forecasts(
                matrix, exogenous=exogenous, name="arima_exo_diff", **orders, **common
            ),
            "arima_exo_eda": lambda: arima_forecasts(
                matrix, exogenous=exogenous, d=0, name="arima_exo_eda", **orders, **common
            ),
            "prophet_exo": lambda: _additive(matrix, m, m.additive_exo, holidays, no_flag, "prophet_exo", common),
        }
    return _union([make() for name, make in makers.items() if name not in m.skip])


def _additive(matrix, m: ModelSpec, tuned, holidays, exogenous, name, common) -> DataFrame:
    """Fixed parameters, or per key the grid candidate with the lowest cross-validated error."""
    if not (tuned.optimize and tuned.grid):
        return additive_forecasts(
            matrix, params=additive_params(tuned), holidays=holidays, exogenous=exogenous, name=name, **common
        )
    keys = common["keys"]
    candidates = params_grid(tuned.grid, additive_params(tuned))
    own = (m.additive_exo_initial_days, m.additive_exo_horizon_days) if exogenous else (m.additive_initial_days, m.additive_horizon_days)
    scores = additive_search(
        matrix, candidates, initial_days=own[0], horizon_days=own[1],
        holidays=holidays, exogenous=exogenous, **common,
    )
    best = cut_lineage(best_additive(scores, keys))
    chosen = [r[0] for r in best.select("candidate").distinct().collect() if r[0] is not None]  # at most the grid
    parts = []
    for i in chosen or [0]:
        forecast = additive_forecasts(
            matrix, params=candidates[i], holidays=holidays, exogenous=exogenous, name=name, **common
        )
        if not chosen:
            return forecast
        parts.append(attach(forecast, best.filter(F.col("candidate") == i), keys).drop("candidate"))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        p = p.withColumns({"step": F.col("step").cast("int"), "pred": F.col("pred").cast("double")})
        out = p if out is None else out.unionByName(p)
    return out


def run(
    spark: SparkSession,
    spec: RunSpec,
    *,
    source: DataFrame | None = None,
    root: str = "",
    holidays: DataFrame | None = None,
    out: str | None = None,
) -> RunResult:
    """Runs the specification on `source` (default: the table it names) and optionally writes the result tables."""
    keys, target, m = list(spec.prepare.keys), spec.extract.prediction_column, spec.model
    notes = svr_grid(m.svr.grid)[1] if m.svr.optimize and "svr" not in m.skip else []
    raw = clean(source, spec) if source is not None else extract(spark, spec, root)
    series = cut_lineage(prepare_series(raw, spec))
    max_test_lag = default_test_lags(longest_series(series, keys))
    levels, orders, variable = choose_work(series, spec, max_test_lag)
    scaled, stats = scale(levels, spec, variable)
    if holidays is None and spec.features.add_holidays:
        holidays = holiday_calendar(spark, spec.features.country, [*spec.features.years_list, *years_of(series)])
    matrix, lag_orders, longest = build_matrix(scaled, spec, variable, holidays)
    matrix = cut_lineage(matrix.drop("diff_order"))

    helpers = ("lag_order", "work", "diff_order", target)
    features = feature_columns(matrix, target=variable, keys=keys, helpers=helpers)
    exogenous = feature_columns(
        matrix, target=variable, keys=keys, helpers=helpers, lags=m.use_lags_on_ts_models,
        engineered=m.use_feature_eng_on_ts_models,
    )
    daily_holidays = holidays if spec.features.add_holidays and spec.prepare.aggr_time_level == "daily" else None
    ts = ts_forecasts(matrix, variable, exogenous, keys, m, spec.mode, daily_holidays, max_test_lag)
    tabular = tabular_forecasts(matrix, variable, features, keys, m)
    base_k = dict(k="lag_order", max_k=longest) if lag_orders is not None else dict(k=longest)
    original = m.use_original_for_baseline
    base_source = with_lag_order(levels, lag_orders, keys) if lag_orders is not None else levels
    base = baseline_forecasts(
        base_source, target=target if original else variable, horizon=m.horizon, keys=keys, **base_k
    )
    # Baselines come from unscaled values; only the other two families are mapped back from the working scale.
    modelled = _union([ts, tabular])
    if stats is not None:
        modelled = invert_scaler(modelled, stats, variable, ["pred"], keys)
    truth = actuals(levels, target=target, horizon=m.horizon, keys=keys)
    modelled = _undo(modelled, truth, orders, keys)
    if not original:
        base = _undo(base, truth, orders, keys)
    families = {
        "ts": [x for x in TS_MODELS + (TS_EXOGENOUS if spec.mode != "ts_only" else ()) if x not in m.skip],
        "tabular": [x for x in TABULAR_MODELS if x not in m.skip],
        "baseline": list(BASELINES),
    }
    every = join_keys(_union([modelled, base]), truth.select(*keys, "step", "y"), [*keys, "step"])
    columns = [*keys, "step", "date", "family", "model", "ord", "pred", "y"]
    single = cut_lineage(ensemble.label(every, families).select(*columns))
    combined = single.unionByName(ensemble.family_averages(single, keys).select(*columns))
    combined = cut_lineage(combined.unionByName(ensemble.stacked_averages(single, keys).select(*columns)))

    s = spec.select
    selection = ensemble.select_model(
        combined, min_steps=s.min_steps, keys=keys, ignore_models=s.ignore_models,
        exclude_families=(ensemble.ENSEMBLE,) if s.exclude_bagging_models else (),
    )
    table, best = score(combined, selection, s.min_steps, keys)
    result = RunResult(series, orders, lag_orders, matrix, combined, selection, table, best, variable, families, notes)
    if out:
        save(result, spec, out)
    return result


def _undo(preds: DataFrame, truth: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    known = attach(preds, orders.select(*keys, "diff_order"), keys)
    return undo_differences(known, truth, order="diff_order", keys=keys).drop("diff_order")


def score(combined: DataFrame, selection: DataFrame, min_steps: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Metric table (scored steps only, selector included) and the summary of the best model per family."""
    chosen = selection.select(
        *keys, "step", "date", F.lit("selector").alias("family"), F.lit(metrics.SELECTOR).alias("model"),
        F.lit(2000).alias("ord"), "pred", "y",
    )
    scored = combined.filter(F.col("step") >= min_steps).unionByName(chosen)
    # an ensemble counts with the family it is made of
    homes = {v: k for table in (ensemble.AVERAGES, ensemble.STACKS) for k, v in table.items()}
    home = F.create_map(*[F.lit(x) for kv in homes.items() for x in kv])
    scored = scored.withColumn("family", F.coalesce(F.try_element_at(home, F.col("model")), F.col("family")))
    table = metrics.metric_table(scored, keys, ("family", "model", "ord"))
    return table, metrics.summary(table, keys)


def save(result: RunResult, spec: RunSpec, out: str, fmt: str = "parquet") -> list[str]:
    pre, keys = spec.prepare, list(spec.prepare.keys)
    scaled = pre.normalize or (pre.normalize_if_not_diff and result.variable == spec.extract.prediction_column)
    name = result_name(
        spec.extract.name.replace("/", "_") or "series", result.variable, spec.model.horizon,
        pre.type_normalization if scaled else None,
    )
    models = [x for f in result.models.values() for x in f]
    models += [*ensemble.AVERAGES.values(), *ensemble.STACKS.values()]
    wide = result.forecasts.groupBy(*keys, "step", "date", "y").pivot("model", models).agg(F.first("pred"))
    tables = {
        "metrics_df": metrics.metric_matrix(result.metrics, [*models, metrics.SELECTOR], keys),
        "fast_summary": metrics.summary_view(result.summary, keys),
        "raw_data": wide,
    }
    return write_results(tables, out, name, fmt)
