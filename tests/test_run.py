"""End to end from one specification, on synthetic series."""

import datetime

import numpy as np
import pytest
import yaml

from chronoloom.plans import load_spec, report_tables, run, spec_from_dict
from chronoloom.operators.ensemble import AVERAGES, STACKS
from chronoloom.operators.metrics import METRICS, SELECTOR

DAILY = """
type_analysis: ts_only
data_extraction: {name: counts, ts_column: Date, prediction_column: n, type_extraction: local_csv, clean_columns_rows: true}
preprocessing:
  deal_na: substitute_interpolate
  difference: one
  aggr_lvl:
  aggr_time: true
  aggr_time_level: daily
  mean_columns: [n]
  type_normalization: z_score
  normalize: true
ts_into_tab: {steps: 3, compute_lags: true, metric: BIC, max_lags: 5, vars_to_lag: []}
feature_eng:
  add_date: true
  add_holidays: true
  country: US
  years_list: [2020]
  mean_vars: [["n", "1", "6"], ["n", "12", "13"]]
  median_vars: []
  mean_weighted_vars: []
model:
  percentage_predicted: 8
  use_original_for_baseline: true
  arima: {max_p: 2, max_q: 1}
  tbats: {max_sp: [7]}
  rf: {optimize_params: false, rf_params: {n_estimators: 5, max_depth: 3}}
  xgb: {optimize_params: false, xgb_params: {n_estimators: 3, max_depth: 2}}
  prophet: {prophet_params: {growth: linear, weekly_seasonality: true}}
model_selector: {min_steps: 3, ignore_models: [last], exclude_bagging_models: false}
EDA: {vars_to_plot_scatter: [["n", "holidays_fe"]], vars_to_add_heatmap: [], feature_eng_vars: true}
"""


def test_spec_reads_the_nested_layout(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text(DAILY)
    spec = load_spec(str(path))
    assert spec.model.horizon == 8 and spec.lags.max_lags == 5 and spec.prepare.keys == ()
    assert spec.features.mean_vars == (("n", 1, 6), ("n", 12, 13)) and spec.prepare.max_difference == 1
    assert spec.model.rf.params["n_estimators"] == 5 and not spec.model.knn.optimize


@pytest.fixture(scope="module")
def daily_result(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    root = tmp_path_factory.mktemp("run")
    start = datetime.date(2020, 1, 1)
    lines = ["Date,n"]
    for i in range(120):
        if i in (30, 31, 77):
            continue
        lines.append(f"{start + datetime.timedelta(days=i)},{40 + 5 * np.sin(2 * np.pi * i / 7) + rng.normal():.3f}")
        if i == 50:
            lines.append("Date,n")
    (root / "counts.csv").write_text("\n".join(lines) + "\n")
    return run(spark, spec_from_dict(yaml.safe_load(DAILY)), root=str(root), out=str(root / "out")), root


def test_single_series_run(spark, daily_result):
    result, root = daily_result
    assert result.series.count() == 120 and result.series.filter("n is null").count() == 0
    models = {m for f in result.models.values() for m in f} | set(AVERAGES.values()) | set(STACKS.values())
    rows = result.forecasts.collect()
    assert {r["model"] for r in rows} == models and len(rows) == 8 * len(models)
    assert not [r["model"] for r in rows if r["pred"] is None]
    assert {r["model"] for r in result.metrics.collect()} == models | {SELECTOR}
    assert "last" not in {r["model"] for r in result.selection.collect()}
    assert result.selection.count() == 5
    families = {(r["metric"], r["family"]) for r in result.summary.collect()}
    assert families == {(m, f) for m in ("Mae", "Mp") for f in ("ts", "tabular", "baseline", "selector")}
    maes = {r["model"]: r["Mae"] for r in result.metrics.collect()}
    assert min(maes["prophet"], maes["tbats"]) < maes["mean_all"]


def test_written_tables(spark, daily_result):
    result, root = daily_result
    base = f"{root}/out/counts_analysis_z_score_{result.variable}_8"
    wide = spark.read.parquet(f"{base}/metrics_df")
    assert {r["Metric"] for r in wide.collect()} == set(METRICS) and SELECTOR in wide.columns
    assert spark.read.parquet(f"{base}/fast_summary").count() == 8
    assert spark.read.parquet(f"{base}/raw_data").count() == 8


def test_report_tables(spark, daily_result):
    result, _ = daily_result
    tables = report_tables(result, spec_from_dict(yaml.safe_load(DAILY)), max_lag=8)
    names = {"correlation", "lag_correlation", "decomposition_n", "rolling_n", "autocorrelation", "partial_autocorrelation",
             "scatter_n_holidays_fe", "binned_n_holidays_fe", "metric_bars", "selected_models", "non_baseline_share", "difference_evolution",
             "decomposition_difference", "rolling_difference"}
    assert set(tables) == names
    pairs = {(r["a"], r["b"]) for r in tables["correlation"].collect()}
    assert ("n", "mean_n_1_6") in pairs and not any("Year" in p for p in pairs)  # the year does not vary
    assert tables["autocorrelation"].filter("lag = 7 and acf > 0.5").count() == 1
    assert tables["partial_autocorrelation"].count() == 8
    assert sum(r["times"] for r in tables["selected_models"].collect()) == 5
    assert tables["scatter_n_holidays_fe"].count() > 0
    assert tables["metric_bars"].count() == 8 * result.metrics.count()


def test_keyed_run_with_exogenous_columns(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, drift in (("p", 0.0), ("q", 1.0)):
        level = 100.0
        for i in range(400):
            level += drift * rng.normal()
            d = datetime.datetime(2019, 1, 1) + datetime.timedelta(days=i)
            rows.append((key, d.strftime("%Y-%m-%d 10:00:00"), f"{level + rng.normal():.2f}".replace(".", ","), float(i % 9)))
    df = spark.createDataFrame(rows, "key string, ts string, v string, temp double")
    spec = spec_from_dict({
        "type_analysis": "ts_num_cat",
        "data_extraction": {"name": "kv", "ts_column": "ts", "prediction_column": "v", "variable_issues": [["v", "european_format"]]},
        "preprocessing": {"date_type": "Y-M-D H:M:S", "difference": "second", "aggr_attr": "key", "aggr_time": True,
                          "aggr_time_level": "weekly", "mean_columns": ["v", "temp"], "columns_to_shift": ["temp"],
                          "normalize_if_not_diff": True, "type_normalization": "robust_scaler",
                          "normalize_independent_var": True, "cut_extremes": True, "fit_on": "train"},
        "ts_into_tab": {"compute_lags": True, "max_lags": 3, "vars_to_lag": ["temp"]},
        "model": {"percentage_predicted": 6, "skip": ["svr", "xgb", "exp_smooth", "rf"], "arima": {"max_p": 1, "max_q": 1},
                  "use_original_for_baseline": False,
                  "knn": {"optimize_params": True, "knn_param_grid": {"n_neighbors": [2, 4]}},
                  "prophet": {"optimize_params": True, "prophet_initial": 150, "prophet_horizon": 50,
                              "prophet_grid": {"weekly_seasonality": [False], "growth": ["linear", "logistic"]}}},
        "model_selector": {"min_steps": 2, "exclude_bagging_models": True},
    })
    result = run(spark, spec, source=df)
    orders = {r["key"]: r["diff_order"] for r in result.orders.collect()}
    assert set(orders) == {"p", "q"} and result.variable == "work"
    rows = result.forecasts.collect()
    assert not [(r["key"], r["model"]) for r in rows if r["pred"] is None]
    assert all(50 < r["pred"] < 200 for r in rows if r["family"] == "baseline")
    assert {r["model"] for r in result.selection.collect()}.isdisjoint({*AVERAGES.values(), *STACKS.values()})
