import datetime

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import columns as fx
from chronoloom.sources import SourceSpec, read_source, result_name, write_results
from chronoloom.sources.cleaning import coerce_numeric, drop_header_rows, fix_numbers, prune_columns


def test_csv_and_parquet_readers(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string").coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    df = read_source(spark, SourceSpec("local_csv", str(tmp_path / "c")))
    assert df.dtypes == [("n", "string"), ("s", "string")]
    coerce_numeric(df).write.parquet(str(tmp_path / "p"))
    back = read_source(spark, SourceSpec("s3_parquet", str(tmp_path / "p")))
    assert sorted(map(tuple, back.collect())) == [(1.0, "a"), (2.0, "b")]
    with pytest.raises(ValueError):
        read_source(spark, SourceSpec("ftp", "x"))


def test_split_reader(spark, tmp_path):
    (tmp_path / "x.txt").write_text("day,value\n2020-01-01,5\nday,value\n2020-01-02,\n")
    df = read_source(spark, SourceSpec("local_excel", str(tmp_path / "x.txt"), split=True))
    assert sorted(map(tuple, df.collect())) == [("2020-01-01", "5"), ("2020-01-02", "")]


def test_header_rows_and_number_formats(spark):
    df = spark.createDataFrame([("y", "1,00%"), ("1.234,56", "1,25%"), (None, None), ("7", "-3,5%")], "y string, p string")
    clean = fix_numbers(drop_header_rows(df, "y"), [("y", "european_format"), ("p", "pct_european")])
    got = {(r["y"], None if r["p"] is None else round(r["p"], 6)) for r in clean.collect()}
    assert got == {(1234.56, 0.0125), (None, None), (7.0, -0.035)}


def test_coercion_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1", "NaN"), ("2.5", "x", "3"), (None, "2", "4")], "a string, b string, c string")
    out = coerce_numeric(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "double"}
    assert [r["c"] for r in out.orderBy("a").collect() if r["c"] is None] == [None]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert coerce_numeric(df).filter("v is null").count() == 1


def test_column_roles(spark):
    df = spark.createDataFrame([("2020", 1.0, 2.0, 3, "t")], "d string, y double, a double, code int, s string")
    assert prune_columns(df, "ts_only", ts="d", target="y").columns == ["d", "y"]
    assert prune_columns(df, "ts_numeric", ts="d", target="y", categoric=["code"]).columns == ["d", "y", "a"]
    assert prune_columns(df, "ts_num_cat", ts="d", target="y").columns == df.columns


def test_dates(spark):
    df = spark.createDataFrame([("2020-02-29", "2020-02", "29/02/2020", "2020/02/29 10:11:12", "30-02"),
                                ("bad", "bad", "bad", "bad", "31-02")], "a string, b string, c string, e string, f string")
    got = df.select(fx.parse_date("a"), fx.parse_date("b"), fx.parse_date("c", "dd/MM/yyyy"), fx.parse_timestamp_day("e"),
                    fx.parse_short_year_month("f", 30)).collect()
    leap, first = datetime.date(2020, 2, 29), datetime.date(2020, 2, 1)
    assert tuple(got[0]) == (leap, first, leap, leap, datetime.date(2030, 2, 1))
    assert tuple(got[1]) == (None, None, None, None, datetime.date(1931, 2, 1))


def test_normal_cdf_and_unit_root_p(spark):
    taus = [(-2.86,), (-3.43,), (-2.57,), (-30.0,), (5.0,)]
    df = spark.createDataFrame(taus, "t double").select(fx.unit_root_p_value(F.col("t")).alias("p"))
    got = [round(r["p"], 3) for r in df.collect()]
    assert got == [0.05, 0.01, 0.099, 0.0, 1.0]


def test_result_names_and_sinks(spark, tmp_path):
    assert result_name("a", "y", 20) == "a_analysis_y_20"
    assert result_name("a", "difference", 20, "z_score") == "a_analysis_z_score_difference_20"
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    for fmt in ("parquet", "csv", "json"):
        path = write_results({"t": df}, str(tmp_path / fmt), "n", fmt)[0]
        reader = spark.read.option("header", True).option("inferSchema", True)
        assert reader.format(fmt).load(path).select("a", "b").first() == (1, 2.0)
