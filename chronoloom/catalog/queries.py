"""One query per operator, each over whole tables. Result columns carry the names the SQL twins use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import columns as fx
from chronoloom.models.additive import AdditiveParams, additive_forecasts, additive_search, params_grid
from chronoloom.models.arima import arima_forecasts
from chronoloom.models.baseline import BASELINES, baseline_forecasts
from chronoloom.models.harmonic import harmonic_forecasts, power_choice, power_harmonic_forecasts
from chronoloom.models.knn import knn_forecasts, knn_search
from chronoloom.models.linear import linear_forecasts
from chronoloom.models.smoothing import holt_forecasts, seasonal_forecasts
from chronoloom.models.svr import svr_forecasts
from chronoloom.models.trees import tree_forecasts
from chronoloom.operators import backtest, diagnostics, ensemble, features, frame, metrics, missing, scaling
from chronoloom.operators import holidays as hol
from chronoloom.operators import stationarity as sta
from chronoloom.operators import quantiles as qt
from chronoloom.operators import timegrid as tg
from chronoloom.operators import transforms as tr
from chronoloom.plans.run import prepare_series, run
from chronoloom.plans.spec import spec_from_dict
from chronoloom.session import cut_lineage, scratch_path
from chronoloom.sources import cleaning, readers, sinks

KEY = ["priority"]
HORIZON = 20
LATEST = 8
WINDOW = 6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def revenue(spark: SparkSession, sf: str, level: str | None = "weekly") -> DataFrame:
    """Whole-currency revenue (y) and number of orders (x) per priority and bucket."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"),
        "o_orderdate",
        F.floor("o_totalprice").alias("y"),
        F.lit(1).alias("x"),
    )
    return tg.bucket_aggregate(rows, ts="o_orderdate", level=level, keys=KEY, sums=["y", "x"])


def gappy(spark: SparkSession, sf: str, level: str = "daily") -> DataFrame:
    return tg.fill_calendar(revenue(spark, sf, level), level=level, keys=KEY)


def complete(spark: SparkSession, sf: str, level: str = "weekly") -> DataFrame:
    """Regular series in which an empty bucket is 0."""
    return missing.fill_value(gappy(spark, sf, level), ["y", "x"], 0)


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly model matrix: four lags, a trailing mean and the calendar parts."""
    df = tr.lag_block(complete(spark, sf), ["y"], 4, KEY)
    return features.add_calendar_parts(features.add_trailing(df, means=[("y", 1, 10)], keys=KEY), "weekly")


FEATURES = ["lag_y_1", "lag_y_2", "lag_y_3", "lag_y_4", "mean_y_1_10", "Year", "Week"]


def baseline_preds(spark: SparkSession, sf: str) -> DataFrame:
    s = complete(spark, sf)
    return baseline_forecasts(s, target="y", horizon=HORIZON, k=LATEST, keys=KEY, with_actual=True)


# Two families out of the six baselines, so that family rules can be checked without fitted models.
TWO_FAMILIES = {"ts": ["last", "mean_latest", "weight_last"], "baseline": ["mean_all", "median_latest", "median"]}


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.label(baseline_preds(spark, sf), TWO_FAMILIES)


# --- sources and cleaning -----------------------------------------------------------------------------------------


@query
def read_csv_typed(spark, sf):
    path = scratch_path(spark)
    cols = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    table(spark, sf, "orders").select(*cols).write.option("header", True).csv(path)
    return cleaning.coerce_numeric(readers.read_source(spark, readers.SourceSpec("local_csv", path)))


@query
def read_parquet_table(spark, sf):
    df = readers.read_source(spark, readers.SourceSpec("local_parquet", f"{sf}/customer.parquet"))
    return df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


@query
def split_reader(spark, sf):
    header = ["key", "priority", "status"]
    rows = table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderpriority", "o_orderstatus").alias("line"))
    head = table(spark, sf, "region").select(F.lit(",".join(header)).alias("line"))
    return readers.split_column(rows.unionByName(head), "line", header)


@query
def split_text_file(spark, sf):
    path = scratch_path(spark)
    rows = table(spark, sf, "customer").select(F.concat_ws(",", "c_custkey", "c_mktsegment").alias("key,segment"))
    rows.write.option("header", True).option("sep", "\u0001").csv(path)  # every part file starts with the header line
    return readers.read_source(spark, readers.SourceSpec("local_excel", path, split=True))


@query
def drop_header_rows(spark, sf):
    text = F.when(F.col("event_type") == "error", F.lit("reading")).otherwise(F.col("value").cast("string"))
    df = table(spark, sf, "events").select("event_id", text.alias("reading"))
    return cleaning.drop_header_rows(df, "reading")


@query
def european_number(spark, sf):
    whole = F.floor("o_totalprice")
    cents = F.round((F.col("o_totalprice") - whole) * 100).cast("int")
    text = F.concat(
        F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(","),
        F.lpad(cents.cast("string"), 2, "0"),
    )
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("price"))
    return cleaning.fix_numbers(df, [("price", "european_format")])


@query
def percent_number(spark, sf):
    text = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(",50%"))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("pct"))
    return rounded(cleaning.fix_numbers(df, [("pct", "pct_european")]), "pct", digits=6)


@query
def safe_numeric(spark, sf):
    mixed = F.when(F.col("o_orderstatus") == "F", F.lit("n/a")).otherwise(F.col("o_custkey").cast("string"))
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("cust"),
        mixed.alias("mixed"), "o_orderpriority",
    )
    return cleaning.coerce_numeric(df)


@query
def column_roles(spark, sf):
    df = table(spark, sf, "lineitem")
    return cleaning.prune_columns(
        df, "ts_numeric", ts="l_shipdate", target="l_extendedprice",
        categoric=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    ).withColumn("l_shipdate", F.to_date("l_shipdate"))


@query
def write_and_read_results(spark, sf):
    path = scratch_path(spark)
    name = sinks.result_name("revenue", "y", HORIZON, "z_score")
    written = sinks.write_results({"raw_data": complete(spark, sf, "monthly")}, path, name)
    return spark.read.parquet(written[0])


# --- dates, buckets, aggregation ----------------------------------------------------------------------------------


@query
def parse_dates(spark, sf):
    day, month = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM")
    slashed = F.date_format("o_orderdate", "dd/MM/yyyy")
    df = table(spark, sf, "orders").select("o_orderkey", day.alias("a"), month.alias("b"), slashed.alias("c"))
    return df.select(
        "o_orderkey", fx.parse_date("a").alias("day"), fx.parse_date("b").alias("month"),
        fx.parse_date("c", "dd/MM/yyyy").alias("slashed"),
    )


@query
def parse_timestamps(spark, sf):
    good = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(good)
    return table(spark, sf, "events").select("event_id", fx.parse_timestamp_day(text).alias("day"))


@query
def parse_short_years(spark, sf):
    text = F.concat_ws("-", F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.date_format("o_orderdate", "MM"))
    return table(spark, sf, "orders").select("o_orderkey", fx.parse_short_year_month(text, 30).alias("month"))


@query
def bucket_daily(spark, sf):
    return revenue(spark, sf, "daily")


@query
def bucket_weekly(spark, sf):
    return revenue(spark, sf, "weekly")


@query
def bucket_monthly(spark, sf):
    return revenue(spark, sf, "monthly")


@query
def bucket_means_and_sums(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_shipdate", F.col("l_quantity").alias("qty"), F.floor("l_extendedprice").alias("price")
    )
    out = tg.bucket_aggregate(rows, ts="l_shipdate", level="weekly", means=["qty"], sums=["price"])
    return rounded(out, "qty")


@query
def bucket_none(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_shipdate", "l_returnflag", F.floor("l_extendedprice").alias("price"))
    out = tg.bucket_aggregate(rows, ts="l_shipdate", level=None, keys=["l_returnflag"], sums=["price"])
    return out.withColumn("date", F.to_date("date"))


@query
def bucket_keyed_first(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_shipdate", "l_returnflag", F.col("l_quantity").alias("qty"), F.floor("l_extendedprice").alias("price"),
        F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")).alias("supplier"), "l_orderkey", "l_linenumber",
    )
    out = tg.bucket_aggregate(
        rows, ts="l_shipdate", level="monthly", keys=["l_returnflag"], means=["qty"], sums=["price"],
        firsts=["supplier"], first_order=["l_shipdate", "l_orderkey", "l_linenumber"],
    )
    return rounded(out, "qty")


@query
def date_ranges(spark, sf):
    return tg.date_range(revenue(spark, sf, "daily"), keys=KEY)


@query
def gap_spine_daily(spark, sf):
    return gappy(spark, sf, "daily")


@query
def gap_spine_weekly(spark, sf):
    return gappy(spark, sf, "weekly")


@query
def gap_spine_monthly(spark, sf):
    return gappy(spark, sf, "monthly")


# --- missing values -----------------------------------------------------------------------------------------------


@query
def drop_null(spark, sf):
    return missing.repair(gappy(spark, sf), "", keys=KEY)


@query
def fill_const(spark, sf):
    return missing.repair(gappy(spark, sf), "substitute_by_value", keys=KEY, value=7)


@query
def fill_mean(spark, sf):
    return rounded(missing.repair(gappy(spark, sf), "substitute_by_mean", keys=KEY), "y", "x")


@query
def fill_median(spark, sf):
    return missing.repair(gappy(spark, sf), "substitute_by_median", keys=KEY)


@query
def fill_carry_forward(spark, sf):
    return missing.repair(gappy(spark, sf), "substitute_backward", keys=KEY)


@query
def fill_take_next(spark, sf):
    return missing.repair(gappy(spark, sf), "substitute_forward", keys=KEY)


@query
def interpolate_linear(spark, sf):
    return rounded(missing.repair(gappy(spark, sf), "substitute_interpolate", keys=KEY), "y", "x")


# --- positional transforms ----------------------------------------------------------------------------------------


@query
def divide_by_constant(spark, sf):
    return tr.divide_columns(complete(spark, sf), ["y"], 8)


@query
def shift_exogenous(spark, sf):
    return tr.shift_columns(complete(spark, sf), ["x"], KEY)


@query
def cut_extremes(spark, sf):
    return tr.cut_extremes(complete(spark, sf), KEY)


@query
def differences(spark, sf):
    return tr.differences(complete(spark, sf), "y", KEY)


@query
def difference_evolution(spark, sf):
    return diagnostics.difference_evolution(tr.differences(complete(spark, sf, "daily"), "y", KEY), KEY)


@query
def lag_block(spark, sf):
    return tr.lag_block(complete(spark, sf), ["y", "x"], 4, KEY)


@query
def lag_block_by_key(spark, sf):
    df = complete(spark, sf).withColumn("k", F.length("priority") % 3 + 1)
    return tr.lag_block_by_order(df, ["y"], 3, "k", KEY)


@query
def newest_rows(spark, sf):
    return frame.tail(complete(spark, sf), KEY, 5)


@query
def oldest_rows(spark, sf):
    return frame.head(complete(spark, sf), KEY, 5)


@query
def single_row_back(spark, sf):
    return frame.row_at(complete(spark, sf), KEY, 3)


@query
def wide_to_long(spark, sf):
    return tr.to_long(complete(spark, sf, "monthly"), [*KEY, "date"], ["y", "x"], "name", "value")


@query
def long_to_wide(spark, sf):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return tr.to_wide(revenue(spark, sf, "monthly").select("date", "priority", "x"), ["date"], "priority", "x", names)


@query
def stack_tables(spark, sf):
    m = revenue(spark, sf, "monthly").select(*KEY, "date", "y", F.lit("monthly").alias("level"))
    w = revenue(spark, sf, "weekly").select(*KEY, "date", "y", F.lit("weekly").alias("level"))
    return tr.stack_tables(m, w)


@query
def zip_tables(spark, sf):
    s = cut_lineage(frame.with_step(complete(spark, sf), KEY, HORIZON).filter("step is not null"))
    return frame.zip_by_step(s.select(*KEY, "step", "y"), s.select(*KEY, "step", "x"), KEY)


# --- normalisation ------------------------------------------------------------------------------------------------


def _scaled(spark, sf, method):
    s = complete(spark, sf)
    return rounded(scaling.scale_series(s, ["y", "x"], method, KEY).select(*s.columns), "y", "x", digits=6)


@query
def norm_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query
def norm_zscore(spark, sf):
    return _scaled(spark, sf, "z_score")


@query
def norm_robust(spark, sf):
    return _scaled(spark, sf, "robust_scaler")


@query
def norm_parameters(spark, sf):
    s = complete(spark, sf)
    out = scaling.stats_long(scaling.fit_scaler(s, ["y", "x"], "z_score", KEY), ["y", "x"], "z_score", KEY)
    return rounded(out, "p1", "p2")


@query
def quantiles_of_long_keys(spark, sf):
    """Quartiles and tails of the prices of raw lines per return flag, a few hundred values in a task at a time."""
    out = qt.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99], ["l_returnflag"], at_most=512)
    names = ("p01", "q25", "median", "q75", "p99")
    return rounded(out.select("l_returnflag", "n", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(names)]), *names)


@query
def norm_train_only(spark, sf):
    s = frame.with_step(complete(spark, sf), KEY, HORIZON)
    out = scaling.scale_series(s, ["y"], "minmax", KEY, keep=F.col("step").isNull())
    return rounded(out.select(*KEY, "date", "y"), "y", digits=6)


@query
def norm_round_trip(spark, sf):
    s = cut_lineage(complete(spark, sf))
    stats = scaling.fit_scaler(s, ["y"], "robust_scaler", KEY)
    back = scaling.invert_scaler(scaling.apply_scaler(s, stats, ["y"], KEY), stats, "y", ["y"], KEY)
    return rounded(back, "y")


# --- features -----------------------------------------------------------------------------------------------------


@query
def roll_mean(spark, sf):
    out = features.add_trailing(complete(spark, sf), means=[("y", 1, 10), ("x", 12, 13)], keys=KEY)
    return rounded(out, "mean_y_1_10", "mean_x_12_13")


@query
def roll_median(spark, sf):
    return features.add_trailing(complete(spark, sf), medians=[("y", 1, 10), ("x", 0, 4)], keys=KEY)


@query
def roll_weighted_mean(spark, sf):
    out = features.add_trailing(complete(spark, sf), weighted=[("y", 1, 10)], keys=KEY)
    return rounded(out, "mean_weighted_y_1_10")


@query
def calendar_weekly(spark, sf):
    return features.add_calendar_parts(complete(spark, sf).select(*KEY, "date"), "weekly")


@query
def calendar_monthly(spark, sf):
    return features.add_calendar_parts(complete(spark, sf, "monthly").select(*KEY, "date"), "monthly")


@query
def calendar_daily(spark, sf):
    return features.add_calendar_parts(complete(spark, sf, "daily").select(*KEY, "date"), "daily")


def _holidays(spark, sf) -> DataFrame:
    return hol.holiday_calendar(spark, "US", hol.years_of(table(spark, sf, "orders"), "o_orderdate"))


@query
def holiday_flag(spark, sf):
    return hol.add_holidays(complete(spark, sf, "daily").select(*KEY, "date"), _holidays(spark, sf), "daily")


@query
def holiday_week(spark, sf):
    return hol.add_holidays(complete(spark, sf, "weekly").select(*KEY, "date"), _holidays(spark, sf), "weekly")


@query
def holiday_month(spark, sf):
    return hol.add_holidays(complete(spark, sf, "monthly").select(*KEY, "date"), _holidays(spark, sf), "monthly")


@query
def holiday_flag_aus(spark, sf):
    """Fixed days with their days in lieu, and the two that go by Easter."""
    calendar = hol.holiday_calendar(spark, "AUS", hol.years_of(table(spark, sf, "orders"), "o_orderdate"))
    return hol.add_holidays(complete(spark, sf, "daily").select(*KEY, "date"), calendar, "daily")


@query
def constant_columns(spark, sf):
    df = complete(spark, sf).withColumn("flat", F.lit(1.0))
    return features.constant_columns(df, ["y", "x", "flat"], KEY)


# --- diagnostics --------------------------------------------------------------------------------------------------


@query
def corr_matrix(spark, sf):
    df = tr.lag_block(complete(spark, sf), ["y"], 2, KEY)
    return rounded(diagnostics.correlation_matrix(df, ["y", "x", "lag_y_1", "lag_y_2"], KEY), "corr", digits=6)


@query
def lag_correlation_report(spark, sf):
    """The columns that the report chooses by itself: the target and its lags, constant ones left out."""
    m = matrix(spark, sf)
    cols = diagnostics.correlation_columns(m.columns, "y", lags=True)
    return rounded(diagnostics.varying(diagnostics.correlation_matrix(m, cols, KEY)), "corr", digits=6)


@query
def binned_counts(spark, sf):
    return diagnostics.binned_counts(complete(spark, sf, "daily"), "y", "x", KEY)


@query
def corr_matrix_wide(spark, sf):
    df = tr.lag_block(complete(spark, sf), ["y", "x"], 11, KEY)
    cols = ["y", "x", *[f"lag_{v}_{i}" for v in "yx" for i in range(1, 12)]]
    return rounded(diagnostics.correlation_matrix(df, cols, KEY), "corr", digits=6)


@query
def hexagon_bins(spark, sf):
    return rounded(diagnostics.hexagon_counts(complete(spark, sf, "daily"), "y", "x", KEY), "mid_x", "mid_y", digits=4)


@query
def decompose_weekly(spark, sf):
    return rounded(diagnostics.decompose(complete(spark, sf), "y", "weekly", KEY), "trend", "seasonal", "resid")


@query
def rolling_six(spark, sf):
    return rounded(diagnostics.rolling_stats(complete(spark, sf), "y", KEY), "rolling_mean", "rolling_std")


@query
def autocorrelation(spark, sf):
    return rounded(diagnostics.autocorrelation(complete(spark, sf), "y", 20, KEY), "acf", "bound", digits=6)


@query
def partial_autocorrelation(spark, sf):
    return rounded(diagnostics.partial_autocorrelation(complete(spark, sf), "y", 20, KEY), "pacf", "bound", digits=6)


@query
def decompose_monthly(spark, sf):
    return rounded(diagnostics.decompose(complete(spark, sf, "monthly"), "y", "monthly", KEY), "trend", "seasonal", "resid")


@query
def decompose_daily(spark, sf):
    return rounded(diagnostics.decompose(complete(spark, sf, "daily"), "y", "daily", KEY), "trend", "seasonal", "resid")


@query
def most_frequent_value(spark, sf):
    return diagnostics.column_mode(complete(spark, sf, "daily"), "x", KEY)


@query
def unit_root_simple(spark, sf):
    out = sta.unit_root_test(complete(spark, sf, "monthly"), "y", keys=KEY, fixed_lag=0)
    return rounded(out.select(*KEY, "stat", "nobs", "p_value"), "stat", "p_value", digits=5)


@query
def unit_root_augmented(spark, sf):
    return rounded(sta.unit_root_test(complete(spark, sf), "y", keys=KEY), "stat", "p_value", digits=5)


@query
def difference_choice(spark, sf):
    out = sta.choose_difference(tr.differences(complete(spark, sf), "y", KEY), "y", keys=KEY)
    return rounded(out, "p_level", "p_first", "p_second", digits=5)


@query
def ar_order_one_score(spark, sf):
    return rounded(sta.lag_order_scores(complete(spark, sf), "y", 1, criterion="BIC", keys=KEY), "score")


@query
def ar_order_choice(spark, sf):
    return sta.choose_lag_order(complete(spark, sf), "y", 12, criterion="HQIC", keys=KEY)


# --- backtest -----------------------------------------------------------------------------------------------------


@query
def backtest_origins(spark, sf):
    return backtest.origins(complete(spark, sf), horizon=HORIZON, keys=KEY).select(*KEY, "date", "step", "train_rows", "y")


@query
def undo_differences(spark, sf):
    s = cut_lineage(complete(spark, sf))
    d = tr.differences(s, "y", KEY)
    p = baseline_forecasts(d, target="secdifference", horizon=HORIZON, k=LATEST, keys=KEY, models=["last"])
    truth = backtest.actuals(s, target="y", horizon=HORIZON, keys=KEY)
    second = backtest.undo_differences(p, truth, order=2, keys=KEY)
    p1 = baseline_forecasts(d, target="difference", horizon=HORIZON, k=LATEST, keys=KEY, models=["last"])
    first = backtest.undo_differences(p1, truth, order=1, keys=KEY)
    return second.select(*KEY, "step", F.col("pred").alias("from_second")).join(
        first.select(*KEY, "step", F.col("pred").alias("from_first")), [*KEY, "step"]
    )


@query
def contiguous_folds(spark, sf):
    return backtest.fold_table(complete(spark, sf), 3, KEY).select(*KEY, "date", "fold")


@query
def expanding_cutoffs(spark, sf):
    return backtest.cutoffs(complete(spark, sf, "daily"), initial_days=1500, horizon_days=120, keys=KEY)


# --- forecasters --------------------------------------------------------------------------------------------------


@query
def baselines(spark, sf):
    return rounded(baseline_forecasts(complete(spark, sf), target="y", horizon=HORIZON, k=LATEST, keys=KEY), "pred")


@query
def baselines_key_window(spark, sf):
    s = complete(spark, sf).withColumn("k", F.length("priority") % 3 + 2)
    out = baseline_forecasts(
        s, target="y", horizon=HORIZON, k="k", max_k=4, keys=KEY, models=["mean_latest", "median_latest", "weight_last"]
    )
    return rounded(out, "pred")


@query
def linear_one_regressor(spark, sf):
    s = tr.lag_block(complete(spark, sf), ["y"], 1, KEY)
    out = linear_forecasts(
        s, target="y", features=["lag_y_1"], horizon=HORIZON, keys=KEY, ridge_alpha=1e12, lasso_alpha=1e10,
        elastic_params=(0.5, 0.5), elastic_grid=None,
    )
    return rounded(out, "pred", digits=1)


@query
def linear_two_regressors(spark, sf):
    s = tr.lag_block(complete(spark, sf), ["y"], 2, KEY)
    out = linear_forecasts(
        s, target="y", features=["lag_y_1", "lag_y_2"], horizon=HORIZON, keys=KEY, models=["linear"], elastic_grid=None
    )
    return rounded(out, "pred", digits=1)


@query
def linear_many_regressors(spark, sf):
    out = linear_forecasts(
        matrix(spark, sf), target="y", features=FEATURES, horizon=HORIZON, keys=KEY, models=["linear", "ridge"],
        elastic_grid=None,
    )
    return rounded(out, "pred", digits=0)


@query
def penalised_three_lags(spark, sf):
    s = tr.lag_block(complete(spark, sf), ["y"], 3, KEY)
    out = linear_forecasts(
        s, target="y", features=["lag_y_1", "lag_y_2", "lag_y_3"], horizon=HORIZON, keys=KEY,
        models=["lasso", "elastic"], lasso_alpha=2e10, elastic_params=(1.0, 0.3), elastic_grid=None,
    )
    return rounded(out, "pred", digits=0)


@query
def linear_models(spark, sf):
    return linear_forecasts(matrix(spark, sf), target="y", features=FEATURES, horizon=HORIZON, keys=KEY)


@query
def knn_forecast(spark, sf):
    s = tr.lag_block(complete(spark, sf), ["y"], 3, KEY)
    lags = ["lag_y_1", "lag_y_2", "lag_y_3"]
    plain = knn_forecasts(s, target="y", features=lags, horizon=HORIZON, keys=KEY, k=5, p=1, name="knn_uniform")
    near = knn_forecasts(
        s, target="y", features=lags, horizon=HORIZON, keys=KEY, k=5, weights="distance", p=2, name="knn_distance"
    )
    return rounded(plain.unionByName(near), "pred", digits=2)


@query
def knn_grid_search(spark, sf):
    s = tr.lag_block(complete(spark, sf), ["y"], 2, KEY)
    return knn_search(s, target="y", features=["lag_y_1", "lag_y_2"], horizon=HORIZON, keys=KEY)


@query
def random_forest(spark, sf):
    return tree_forecasts(
        matrix(spark, sf), target="y", features=FEATURES, horizon=HORIZON, keys=KEY, kind="rf",
        params={"n_estimators": 20, "max_depth": 6, "max_features": "sqrt", "min_samples_split": 2},
    )


@query
def boosted_trees(spark, sf):
    return tree_forecasts(
        matrix(spark, sf), target="y", features=FEATURES, horizon=HORIZON, keys=KEY, kind="gbt",
        params={"n_estimators": 10, "max_depth": 3, "learning_rate": 0.2, "colsample_bytree": 0.7},
    )


@query
def support_vector(spark, sf):
    return svr_forecasts(matrix(spark, sf), target="y", features=FEATURES, horizon=HORIZON, keys=KEY, C=1e5)


@query
def holt(spark, sf):
    out = holt_forecasts(
        complete(spark, sf, "monthly"), target="y", horizon=HORIZON, keys=KEY, alphas=(0.2, 0.5, 0.8), betas=(0.1, 0.6)
    )
    return rounded(out, "pred", digits=2)


@query
def seasonal_smoothing(spark, sf):
    out = seasonal_forecasts(
        complete(spark, sf), target="y", horizon=HORIZON, keys=KEY, periods=(4,), weights=(0.1, 0.5)
    )
    return rounded(out, "pred", digits=1)


@query
def holt_winters(spark, sf):
    return seasonal_forecasts(complete(spark, sf), target="y", horizon=HORIZON, keys=KEY)


def _refined(spark, sf, make, rounds=4, **args) -> DataFrame:
    """Per key: are the errors of refined weights never above those of the grid's best point, and below them somewhere?"""
    s = complete(spark, sf, "monthly")
    grid, fine = (make(s, target="y", horizon=HORIZON, keys=KEY, refine=r, detail=True, **args) for r in (0, rounds))
    pair = grid.select(*KEY, "step", F.col("loss").alias("coarse")).join(fine.select(*KEY, "step", "pred", "loss"), [*KEY, "step"])
    fitted = pair.filter(F.col("coarse") > 0)  # an error of nothing, as after two values, can't fall
    return fitted.groupBy(*KEY).agg(
        F.count_if(F.col("pred").isNull()).alias("missing"),
        F.bool_and(F.col("loss") <= F.col("coarse")).alias("never_worse"),
        F.bool_or(F.col("loss") < F.col("coarse")).alias("somewhere_better"))


@query
def holt_refined(spark, sf):
    return holt_forecasts(complete(spark, sf, "monthly"), target="y", horizon=HORIZON, keys=KEY, refine=4)


@query
def holt_refined_facts(spark, sf):
    return _refined(spark, sf, holt_forecasts)


@query
def seasonal_refined_facts(spark, sf):
    return _refined(spark, sf, seasonal_forecasts, rounds=2, periods=(4, 7))


@query
def arima(spark, sf):
    return arima_forecasts(complete(spark, sf), target="y", horizon=HORIZON, keys=KEY)


@query
def arima_likelihood(spark, sf):
    return arima_forecasts(complete(spark, sf), target="y", horizon=HORIZON, keys=KEY, method="likelihood", name="arima_ml")


@query
def arima_exogenous_likelihood(spark, sf):
    s = tr.shift_columns(complete(spark, sf), ["x"], KEY)
    return arima_forecasts(s, target="y", horizon=HORIZON, keys=KEY, exogenous=["x"], d=0, max_p=3, max_q=2, method="likelihood", name="arima_exo_ml")


@query
def arima_fixed_order(spark, sf):
    out = arima_forecasts(complete(spark, sf), target="y", horizon=HORIZON, keys=KEY, d=0, name="arima_eda")
    return rounded(out, "pred", digits=0)


@query
def arima_exogenous(spark, sf):
    s = tr.shift_columns(complete(spark, sf), ["x"], KEY)
    return arima_forecasts(
        s, target="y", horizon=HORIZON, keys=KEY, exogenous=["x"], max_p=3, max_q=2, name="arima_exo_diff"
    )


@query
def arima_exogenous_fixed_order(spark, sf):
    s = tr.shift_columns(complete(spark, sf), ["x"], KEY)
    out = arima_forecasts(
        s, target="y", horizon=HORIZON, keys=KEY, exogenous=["x"], d=0, max_p=3, max_q=2, name="arima_exo_eda"
    )
    return rounded(out, "pred", digits=0)


@query
def harmonic(spark, sf):
    return rounded(harmonic_forecasts(complete(spark, sf, "daily"), target="y", horizon=HORIZON, keys=KEY), "pred", digits=0)


@query
def harmonic_power(spark, sf):
    return power_harmonic_forecasts(complete(spark, sf), target="y", horizon=HORIZON, keys=KEY, periods=(4, 13, 52), name="tbats_ml")


@query
def harmonic_power_facts(spark, sf):
    return _facts(harmonic_power(spark, sf), spark, sf)


@query
def power_of_trend(spark, sf):
    """The power transform that makes monthly revenue most nearly a straight line."""
    out = power_choice(complete(spark, sf, "monthly"), target="y", horizon=HORIZON, keys=KEY, periods=(), max_order=0)
    return out.select(*KEY, "power", "harmonics")


@query
def additive_weekly(spark, sf):
    out = additive_forecasts(
        complete(spark, sf, "daily"), target="y", horizon=HORIZON, keys=KEY, holidays=_holidays(spark, sf), changepoints=3,
        params=AdditiveParams(changepoint_prior="normal"),
    )
    return rounded(out, "pred", digits=0)


@query
def additive(spark, sf):
    return additive_forecasts(
        complete(spark, sf, "daily"), target="y", horizon=HORIZON, keys=KEY, holidays=_holidays(spark, sf),
        params=AdditiveParams(yearly_seasonality=True),
    )


@query
def additive_exogenous(spark, sf):
    s = tr.shift_columns(complete(spark, sf), ["x"], KEY)
    return additive_forecasts(
        s, target="y", horizon=HORIZON, keys=KEY, exogenous=["x"], name="prophet_exo",
        params=AdditiveParams(growth="logistic", weekly_seasonality=False, yearly_seasonality=True),
    )


@query
def additive_grid_scores(spark, sf):
    grid = params_grid({"growth": ["linear", "logistic"], "weekly_seasonality": [False],
                        "changepoint_prior_scale": [0.01, 0.5]})
    return additive_search(
        complete(spark, sf), grid, target="y", horizon=HORIZON, initial_days=1200, horizon_days=200, keys=KEY
    )


# --- ensembles, selection, metrics --------------------------------------------------------------------------------


@query
def family_averages(spark, sf):
    out = ensemble.family_averages(labelled(spark, sf), KEY)
    return rounded(out.select(*KEY, "step", "model", "pred", "y"), "pred")


@query
def stacked_averages(spark, sf):
    out = ensemble.stacked_averages(labelled(spark, sf), KEY).select(*KEY, "step", "model", "pred")
    return rounded(out, "pred", digits=1)


@query
def stacked_one_model(spark, sf):
    one = ensemble.label(baseline_preds(spark, sf), {"ts": ["mean_all"], "baseline": ["weight_last"]})
    out = ensemble.stacked_averages(one, KEY).select(*KEY, "step", "model", "pred")
    return rounded(out, "pred", digits=1)


def _selection(spark, sf) -> DataFrame:
    return ensemble.select_model(labelled(spark, sf), min_steps=WINDOW, keys=KEY)


@query
def selector(spark, sf):
    return rounded(_selection(spark, sf), "pred", "window_mae")


@query
def selector_with_exclusions(spark, sf):
    p = labelled(spark, sf)
    every = p.select(*KEY, "step", "date", "family", "model", "ord", "pred", "y").unionByName(
        ensemble.family_averages(p, KEY)
    )
    out = ensemble.select_model(
        every, min_steps=WINDOW, keys=KEY, ignore_models=["last"], exclude_families=[ensemble.ENSEMBLE]
    )
    return rounded(out.select(*KEY, "step", "model", "pred"), "pred")


@query
def selector_counts(spark, sf):
    return diagnostics.value_counts(_selection(spark, sf), "model")


@query
def selector_share(spark, sf):
    return rounded(metrics.non_baseline_share(_selection(spark, sf), TWO_FAMILIES["baseline"], KEY), "non_baseline_pct")


@query
def best_model_per_key(spark, sf):
    return rounded(ensemble.best_model_per_key(labelled(spark, sf), KEY), "mae")


@query
def mean_error_of_models(spark, sf):
    return rounded(ensemble.mean_error_of_models(labelled(spark, sf), KEY), "mean_mae")


@query
def closest_to_zero(spark, sf):
    d = tr.differences(complete(spark, sf), "y", KEY)
    return ensemble.closest_to_zero(d, ["difference", "secdifference"]).select(*KEY, "date", "closest")


@query
def row_minimum(spark, sf):
    d = tr.lag_block(complete(spark, sf), ["y"], 2, KEY)
    return diagnostics.row_minimum(d, ["y", "lag_y_1", "lag_y_2"]).select(*KEY, "date", "row_min")


def _metric_table(spark, sf) -> DataFrame:
    scored = labelled(spark, sf).filter(F.col("step") >= WINDOW)
    return metrics.metric_table(scored, KEY, ("family", "model", "ord"))


@query
def metric_table(spark, sf):
    return rounded(_metric_table(spark, sf).drop("ord"), *metrics.METRICS, digits=3)


@query
def metric_rows(spark, sf):
    out = metrics.metric_rows(_metric_table(spark, sf).drop("ord", "family"), KEY)
    return rounded(out, "value", digits=3)


@query
def metric_matrix(spark, sf):
    out = metrics.metric_matrix(_metric_table(spark, sf), BASELINES, KEY)
    return rounded(out, *BASELINES, digits=3)


@query
def adjusted_r2(spark, sf):
    return rounded(metrics.adjusted_r2(labelled(spark, sf), 1, KEY), "adj_r2", digits=6)


@query
def summary(spark, sf):
    return rounded(metrics.summary(_metric_table(spark, sf), KEY), "value", digits=3)


@query
def whole_run(spark, sf):
    """The full chain on weekly shipments per return flag, from dirty text to the metric table."""
    spec = spec_from_dict(
        {
            "type_analysis": "ts_num_cat",
            "data_extraction": {"name": "shipped", "ts_column": "day", "prediction_column": "price"},
            "preprocessing": {
                "date_type": "Y-M-D H:M:S", "difference": "second", "aggr_attr": "flag", "aggr_time": True,
                "aggr_time_level": "weekly", "mean_columns": ["qty"], "sum_columns": ["price"],
                "columns_to_shift": ["qty"], "type_normalization": "z_score", "normalize": True, "cut_extremes": True,
                "deal_na": "substitute_interpolate",
            },
            "ts_into_tab": {"steps": 4, "compute_lags": False, "vars_to_lag": ["qty"]},
            "feature_eng": {"add_date": True, "add_holidays": True, "country": "US", "years_list": [],
                            "mean_vars": [["price", 1, 10]]},
            "model": {
                "percentage_predicted": HORIZON,
                "xgb": {"xgb_params": {"n_estimators": 10, "max_depth": 3}},
                "elastic": {"optimize_params": True, "elastic_param_grid": {"alpha": [0.01, 1.0, 10.0], "l1_ratio": [0.1, 0.5, 0.9]}},
                "rf": {"rf_params": {"n_estimators": 10, "max_depth": 5}},
                "prophet": {"prophet_params": {"weekly_seasonality": False, "yearly_seasonality": True}},
                "prophet_ex": {"prophet_ex_params": {"weekly_seasonality": False, "yearly_seasonality": True}},
            },
            "model_selector": {"min_steps": WINDOW},
        }
    )
    rows = table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("day"), F.col("l_returnflag").alias("flag"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"),
    )
    return run(spark, spec, source=rows).metrics.drop("ord")


def _facts(forecasts: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """What must hold for any fit: a forecast per origin, none missing, none outside the range of the values seen."""
    seen = complete(spark, sf).groupBy(*KEY).agg(F.min("y").alias("low"), F.max("y").alias("high"))
    width = F.col("high") - F.col("low")
    inside = F.col("pred").between(F.col("low") - width, F.col("high") + width)
    return forecasts.join(seen, KEY).groupBy(*KEY, "model").agg(
        F.count(F.lit(1)).alias("forecasts"), F.count_if(F.col("pred").isNull()).alias("missing"), F.bool_and(inside).alias("inside"))


@query
def random_forest_facts(spark, sf):
    return _facts(random_forest(spark, sf), spark, sf)


@query
def boosted_trees_facts(spark, sf):
    return _facts(boosted_trees(spark, sf), spark, sf)


@query
def support_vector_facts(spark, sf):
    return _facts(support_vector(spark, sf), spark, sf)


@query
def arima_likelihood_facts(spark, sf):
    return _facts(arima_likelihood(spark, sf), spark, sf)


@query
def arima_exogenous_likelihood_facts(spark, sf):
    return _facts(arima_exogenous_likelihood(spark, sf), spark, sf)


@query
def additive_large_offset(spark, sf):
    """A regressor at 10^9 that varies by units says as much as one at 0: the difference of the forecasts is nothing."""
    near = complete(spark, sf).withColumn("x", F.dayofyear("date").cast("double"))
    flat = AdditiveParams(growth="flat", weekly_seasonality=False)
    both = [additive_forecasts(near.withColumn("x", F.col("x") + F.lit(level)), target="y", horizon=HORIZON, keys=KEY, exogenous=["x"], params=flat, name=name)
            for level, name in ((0.0, "near"), (1e9, "far"))]
    pair = both[0].select(*KEY, "step", F.col("pred").alias("near")).join(both[1].select(*KEY, "step", F.col("pred").alias("far")), [*KEY, "step"])
    return pair.groupBy(*KEY).agg(F.count(F.lit(1)).alias("forecasts"), F.bool_and(F.abs(F.col("far") - F.col("near")) <= 1e-6 * F.abs("near")).alias("same"))


# --- one series without keys ----------------------------------------------------------------------------------------


def _alone(spark: SparkSession, sf: str, level: str = "weekly", filled: bool = True) -> DataFrame:
    """Revenue of all orders as a single regular series; an empty bucket is 0 if `filled`, else NULL."""
    rows = table(spark, sf, "orders").select("o_orderdate", F.floor("o_totalprice").alias("y"), F.lit(1).alias("x"))
    series = tg.fill_calendar(tg.bucket_aggregate(rows, ts="o_orderdate", level=level, sums=["y", "x"]), level=level)
    return missing.fill_value(series, ["y", "x"], 0) if filled else series


@query
def single_gap_spine(spark, sf):
    return _alone(spark, sf, "daily", filled=False)


@query
def single_interpolate(spark, sf):
    return rounded(missing.interpolate(_alone(spark, sf, "daily", filled=False), ["y", "x"]), "y", "x")


@query
def single_differences(spark, sf):
    return tr.differences(_alone(spark, sf), "y")


@query
def single_lag_block(spark, sf):
    return tr.lag_block(_alone(spark, sf), ["y", "x"], 4)


@query
def single_unit_root(spark, sf):
    out = sta.unit_root_test(_alone(spark, sf, "monthly"), "y", fixed_lag=0)
    return rounded(out.select("stat", "nobs", "p_value"), "stat", "p_value", digits=5)


@query
def single_ar_order_score(spark, sf):
    return rounded(sta.lag_order_scores(_alone(spark, sf), "y", 1, criterion="BIC"), "score")


@query
def single_baselines(spark, sf):
    return rounded(baseline_forecasts(_alone(spark, sf), target="y", horizon=HORIZON, k=LATEST), "pred")


@query
def single_linear(spark, sf):
    s = tr.lag_block(_alone(spark, sf), ["y"], 1)
    out = linear_forecasts(
        s, target="y", features=["lag_y_1"], horizon=HORIZON, ridge_alpha=1e12, lasso_alpha=1e10, elastic_params=(0.5, 0.5),
        elastic_grid=None,
    )
    return rounded(out, "pred", digits=1)


@query
def linear_large_offset(spark, sf):
    """A regressor whose level is millions of times its spread."""
    s = tr.lag_block(complete(spark, sf), ["y"], 1, KEY).withColumn("far", F.col("lag_y_1") + 1e12)
    out = linear_forecasts(s, target="y", features=["far"], horizon=HORIZON, keys=KEY, models=["linear"], elastic_grid=None)
    return rounded(out, "pred", digits=1)


@query
def single_knn(spark, sf):
    s = tr.lag_block(_alone(spark, sf), ["y"], 3)
    lags = ["lag_y_1", "lag_y_2", "lag_y_3"]
    plain = knn_forecasts(s, target="y", features=lags, horizon=HORIZON, k=5, p=1, name="knn_uniform")
    near = knn_forecasts(s, target="y", features=lags, horizon=HORIZON, k=5, weights="distance", p=2, name="knn_distance")
    return rounded(plain.unionByName(near), "pred", digits=2)


def _alone_labelled(spark: SparkSession, sf: str) -> DataFrame:
    preds = baseline_forecasts(_alone(spark, sf), target="y", horizon=HORIZON, k=LATEST, with_actual=True)
    return ensemble.label(preds, TWO_FAMILIES)


@query
def single_selector(spark, sf):
    return rounded(ensemble.select_model(_alone_labelled(spark, sf), min_steps=WINDOW), "pred", "window_mae")


@query
def single_metric_table(spark, sf):
    scored = _alone_labelled(spark, sf).filter(F.col("step") >= WINDOW)
    return rounded(metrics.metric_table(scored, [], ("family", "model")), *metrics.METRICS, digits=3)


@query
def unbucketed_events(spark, sf):
    """Event values per type without a bucket level: dates are cut to days, several rows a day are averaged, gaps stay."""
    spec = spec_from_dict({
        "type_analysis": "ts_num_cat", "data_extraction": {"ts_column": "ts", "prediction_column": "value"},
        "preprocessing": {"date_type": "Y-M-D", "aggr_attr": "event_type", "aggr_time": False, "mean_columns": ["value"],
                          "deal_na": "drop_na"},
    })
    rows = table(spark, sf, "events").select("ts", "event_type", "value")
    return rounded(prepare_series(rows, spec).select("event_type", "date", "value"), "value", digits=8)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly revenue per priority -> baselines -> recent-performance selection -> error metrics."""
    s = missing.interpolate(gappy(spark, sf, "monthly"), ["y", "x"], KEY)
    p = baseline_forecasts(s, target="y", horizon=HORIZON, k=LATEST, keys=KEY, with_actual=True)
    p = ensemble.label(p, {"baseline": list(BASELINES)})
    chosen = ensemble.select_model(p, min_steps=WINDOW, keys=KEY)
    scored = p.filter(F.col("step") >= WINDOW).select(*KEY, "step", "model", "pred", "y").unionByName(
        chosen.select(*KEY, "step", F.lit(metrics.SELECTOR).alias("model"), "pred", "y")
    )
    return rounded(metrics.metric_table(scored, KEY), *metrics.METRICS, digits=3)


QUERIES["revenue_model_comparison"] = flagship

