"""Plan shapes and skew: what must hold for large inputs, checked on small ones."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.models.baseline import baseline_forecasts
from chronoloom.models.knn import knn_forecasts
from chronoloom.models.linear import linear_forecasts
from chronoloom.operators.ensemble import label, select_model
from chronoloom.operators.features import add_calendar_parts, add_trailing
from chronoloom.operators.gram import cross_products
from chronoloom.operators.missing import interpolate
from chronoloom.operators.scaling import scale_series
from chronoloom.operators.timegrid import bucket_aggregate, fill_calendar
from chronoloom.operators.transforms import differences, lag_block
from chronoloom.session import cut_lineage

K = ["key"]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Two thirds of the rows belong to one key, and half of those to one day."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 else f"k{i % 10}"
        day = 17 if key == "hot" and i % 2 else int(rng.integers(0, 90))
        rows.append((key, datetime.datetime(2021, 1, 1, 8) + datetime.timedelta(days=day), int(rng.integers(1, 100)), "junk"))
    path = str(tmp_path_factory.mktemp("raw") / "t")
    spark.createDataFrame(rows, "key string, ts timestamp, v long, unused string").write.parquet(path)
    return spark.read.parquet(path)


def series_of(raw):
    return fill_calendar(bucket_aggregate(raw, ts="ts", level="daily", keys=K, sums=["v"]), level="daily", keys=K)


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return text, len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", text)), text.count("FileScan"), text.count("Join")


def test_raw_rows_are_pruned_filtered_and_partly_aggregated_before_the_shuffle(raw):
    text, exchanges, scans, joins = plan(bucket_aggregate(raw, ts="ts", level="weekly", keys=K, sums=["v"], means=["v"]))
    assert (exchanges, scans, joins) == (1, 1, 0)
    assert "partial_sum" in text and "IsNotNull(ts)" in text and "unused" not in text


def test_the_series_chain_has_one_scan_two_shuffles_and_no_join(raw):
    s = interpolate(series_of(raw), ["v"], K)
    s = lag_block(differences(s, "v", K), ["v"], 3, K)
    s = add_calendar_parts(add_trailing(s, means=[("v", 1, 5)], medians=[("v", 0, 3)], weighted=[("v", 1, 4)], keys=K), "daily")
    _, exchanges, scans, joins = plan(scale_series(s, ["v"], "robust", K))
    assert (exchanges, scans, joins) == (2, 1, 0)


def test_forecasters_add_no_join_and_at_most_one_small_shuffle(raw):
    s = lag_block(interpolate(series_of(raw), ["v"], K), ["v"], 2, K)
    lags = ["lag_v_1", "lag_v_2"]
    assert plan(baseline_forecasts(s, target="v", horizon=5, k=3, keys=K))[1:] == (2, 1, 0)
    assert plan(knn_forecasts(s, target="v", features=lags, horizon=5, keys=K, k=3))[1:] == (2, 1, 0)
    assert plan(linear_forecasts(s, target="v", features=lags, horizon=5, keys=K))[1:] == (3, 1, 0)


def test_selection_adds_one_shuffle(raw):
    p = baseline_forecasts(interpolate(series_of(raw), ["v"], K), target="v", horizon=8, k=3, keys=K, with_actual=True)
    chosen = select_model(label(p, {"baseline": ["last", "mean_all", "median"]}), min_steps=3, keys=K)
    assert plan(chosen)[1:] == (3, 1, 0)


def test_hot_key_totals(raw):
    got = {(r["key"], r["date"]): r["v"] for r in bucket_aggregate(raw, ts="ts", level="daily", keys=K, sums=["v"]).collect()}
    want = {}
    for r in raw.collect():
        want[r["key"], r["ts"].date()] = want.get((r["key"], r["ts"].date()), 0) + r["v"]
    assert got == want


def test_a_hot_key_sends_few_cells(spark, raw):
    cells = cross_products(raw.withColumn("date", F.to_date("ts")), [F.lit(1.0), "v", "v"], keys=K)
    sent = {r["key"]: r["count"] for r in cells.groupBy("key").count().collect()}
    assert sent["hot"] <= raw.rdd.getNumPartitions()
    assert cells.agg(F.sum("__count")).first()[0] == 6000


def test_lineage_cut_is_a_reliable_checkpoint(spark, raw):
    cut = cut_lineage(series_of(raw))
    text = cut._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in text and "FileScan" not in text
    assert cut.rdd.isCheckpointed() or spark.sparkContext.getCheckpointDir()
