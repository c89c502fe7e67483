"""Public-holiday calendars built from rule rows, and the features joined from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.columns import bucket, easter_sunday

# National holidays as (country, name, kind, month, day-or-n, weekday, first year, observed).
# kind: fixed = month/day; nth = n-th weekday of the month; last = last weekday of the month; easter = day offset.
# observed: nearest = Saturday to Friday and Sunday to Monday; next = weekend to Monday (Christmas and Boxing Day: two days on).
HOLIDAY_RULES = [
    ("US", "New Year's Day", "fixed", 1, 1, None, 1871, "nearest"),
    ("US", "Martin Luther King Jr. Day", "nth", 1, 3, "MON", 1986, None),
    ("US", "Washington's Birthday", "nth", 2, 3, "MON", 1971, None),
    ("US", "Memorial Day", "last", 5, 0, "MON", 1971, None),
    ("US", "Juneteenth National Independence Day", "fixed", 6, 19, None, 2021, "nearest"),
    ("US", "Independence Day", "fixed", 7, 4, None, 1871, "nearest"),
    ("US", "Labor Day", "nth", 9, 1, "MON", 1894, None),
    ("US", "Columbus Day", "nth", 10, 2, "MON", 1971, None),
    ("US", "Veterans Day", "fixed", 11, 11, None, 1978, "nearest"),
    ("US", "Thanksgiving", "nth", 11, 4, "THU", 1942, None),
    ("US", "Christmas Day", "fixed", 12, 25, None, 1871, "nearest"),
    ("AUS", "New Year's Day", "fixed", 1, 1, None, 1901, "next"),
    ("AUS", "Australia Day", "fixed", 1, 26, None, 1935, "next"),
    ("AUS", "Good Friday", "easter", 0, -2, None, 1901, None),
    ("AUS", "Easter Monday", "easter", 0, 1, None, 1901, None),
    ("AUS", "Anzac Day", "fixed", 4, 25, None, 1921, None),
    ("AUS", "Christmas Day", "fixed", 12, 25, None, 1901, "next"),
    ("AUS", "Boxing Day", "fixed", 12, 26, None, 1901, "next"),
]

_RULE_SCHEMA = "country string, name string, kind string, month int, d int, weekday string, since int, shift string"


def holiday_calendar(
    spark: SparkSession, country: str, years: Sequence[int], observed: bool = True, rules=None
) -> DataFrame:
    """(country, date, name) for the given years. The row count is rules x years, so it is always small."""
    chosen = [r for r in (rules or HOLIDAY_RULES) if r[0] == country]
    if not chosen:
        raise ValueError(f"no holiday rules for {country!r}; pass your own rules or holiday table")
    years = sorted({int(y) for y in years})
    if not years:
        raise ValueError("a holiday calendar needs at least one year")
    around = sorted({y + d for y in years for d in (-1, 0, 1)})  # an observed day may fall in the next year
    base = spark.createDataFrame(chosen, _RULE_SCHEMA).coalesce(1)
    base = base.withColumn("year", F.explode(F.array(*[F.lit(y) for y in around]))).filter("year >= since")
    month_start = F.make_date("year", F.greatest("month", F.lit(1)), F.lit(1))
    nth = F.expr("date_add(next_day(date_sub(make_date(year, greatest(month, 1), 1), 1), weekday), 7 * (d - 1))")
    last = F.expr("next_day(date_sub(last_day(make_date(year, greatest(month, 1), 1)), 7), weekday)")
    day = (
        F.when(F.col("kind") == "fixed", F.date_add(month_start, F.col("d") - 1))
        .when(F.col("kind") == "nth", nth)
        .when(F.col("kind") == "last", last)
        .otherwise(F.date_add(easter_sunday(F.col("year")), F.col("d")))
    )
    # the generator keeps the date rule from being copied into every later mention of `date`
    base = base.select("*", F.explode(F.array(day)).alias("date"))
    inside = F.year("date").isin(years)
    out = base.filter(inside).select("country", "date", "name")
    if observed:
        weekday = F.dayofweek("date")  # 1 = Sunday, 7 = Saturday
        christmas_pair = F.when(F.col("name").isin("Christmas Day", "Boxing Day"), F.lit(2))
        moved = (
            F.when((F.col("shift") == "nearest") & (weekday == 7), F.date_sub("date", 1))
            .when((F.col("shift") == "nearest") & (weekday == 1), F.date_add("date", 1))
            .when((F.col("shift") == "next") & (weekday == 7), F.date_add("date", 2))
            .when((F.col("shift") == "next") & (weekday == 1), F.date_add("date", F.coalesce(christmas_pair, F.lit(1))))
        )
        extra = base.withColumn("date", moved).filter(F.col("date").isNotNull() & inside)
        out = out.unionByName(extra.select("country", "date", F.concat("name", F.lit(" (observed)")).alias("name")))
    return out


def years_of(df: DataFrame, date: str = "date") -> list[int]:
    """The years that the dates of `df` span: one aggregated row."""
    low, high = df.agg(F.year(F.min(date)), F.year(F.max(date))).first()
    return list(range(low, high + 1)) if low is not None else []


def add_holidays(df: DataFrame, holidays: DataFrame, level: str, date: str = "date") -> DataFrame:
    """`holidays_fe`: 0/1 flag for daily series, count of distinct holiday dates in the bucket for weekly and monthly.

    A date in a year before the first or after the last year of the calendar is not known to be free: it gets NULL.

    The holiday side is one row per calendar bucket of the listed years, so its size does not grow with the series
    and broadcasting it is safe.
    """
    days = holidays.select(F.col("date").alias("__day")).distinct()
    if level == "daily":
        marks = days.select(F.col("__day").alias(date), F.lit(1).alias("holidays_fe"))
    else:
        marks = days.groupBy(bucket("__day", level).alias(date)).agg(F.count(F.lit(1)).cast("int").alias("holidays_fe"))
    span = days.agg(F.year(F.min("__day")).alias("__low"), F.year(F.max("__day")).alias("__high"))
    marked = df.join(F.broadcast(marks), date, "left").join(F.broadcast(span), how="cross")  # one row
    known = F.year(date).between(F.col("__low"), F.col("__high"))
    flag = F.coalesce("holidays_fe", F.when(known, F.lit(0)))
    return marked.withColumn("holidays_fe", flag).drop("__low", "__high")
