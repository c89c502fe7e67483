"""Scalar column expressions: text-to-number repair, date parsing, calendar buckets, distribution tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three bucket levels and the length of one step of each.
LEVEL_STEPS = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month"}

# Timestamp layouts tried in order when a column mixes styles.
TIMESTAMP_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: str | Column) -> Column:
    """Spark aggregates count NaN as a value; missing data must be NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def european_number(c: str | Column) -> Column:
    """'1.234,56' -> 1234.56; text that does not parse becomes NULL."""
    return F.replace(F.replace(col(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def european_percent(c: str | Column) -> Column:
    """'1,25%' -> 0.0125."""
    return F.replace(F.replace(col(c), F.lit("%"), F.lit("")), F.lit(","), F.lit(".")).try_cast("double") / 100


def parse_date(c: str | Column, fmt: str | None = None) -> Column:
    """Day (or first of month for year-month text). Unparsable text becomes NULL."""
    c = col(c)
    if fmt:
        return F.to_date(F.try_to_timestamp(c, F.lit(fmt)))
    text = c.cast("string")
    return F.to_date(
        F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM")))
    )


def parse_timestamp_day(c: str | Column, layouts: Sequence[str] = TIMESTAMP_LAYOUTS) -> Column:
    """Date part of a timestamp text in any of the layouts; bad values become NULL."""
    text = col(c).cast("string")
    tries = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in layouts]
    return F.to_date(F.coalesce(*tries))


def parse_short_year_month(c: str | Column, pivot: int) -> Column:
    """'YY-MM' -> first of month; years up to `pivot` belong to this century, later ones to the last."""
    text = col(c)
    century = F.when(F.substring(text, 1, 2).try_cast("int") <= F.lit(pivot), F.lit("20")).otherwise(F.lit("19"))
    return F.to_date(F.try_to_timestamp(F.concat(century, text), F.lit("yyyy-MM")))


def bucket(c: str | Column, level: str | None) -> Column:
    """Start of the day / ISO week (Monday) / month; `None` keeps the time as it is."""
    c = col(c)
    if level is None:
        return c
    if level == "daily":
        return F.to_date(c)
    if level == "weekly":
        return F.to_date(F.date_trunc("week", c))
    if level == "monthly":
        return F.trunc(c, "MM")
    raise ValueError(f"unknown bucket level {level!r}")


def step_back(c: Column, level: str) -> Column:
    """The bucket start just before `c`."""
    if level == "monthly":
        return F.add_months(c, -1)
    return F.date_sub(c, 7 if level == "weekly" else 1)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (Abramowitz & Stegun 7.1.26, error below 1.5e-7)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def unit_root_p_value(tau: Column) -> Column:
    """p-value of the Dickey-Fuller statistic with a constant (MacKinnon 1994 response surface)."""
    low = 2.1659 + 1.4412 * tau + 0.038269 * tau * tau
    high = 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau
    return (
        F.when(tau.isNull(), F.lit(1.0))
        .when(tau < -18.83, F.lit(0.0))
        .when(tau <= -1.61, normal_cdf(low))
        .when(tau <= 2.74, normal_cdf(high))
        .otherwise(F.lit(1.0))
    )


def huber(error: Column, delta: float = 1.0) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, error * error / 2).otherwise(delta * (a - delta / 2))


def pinball(error: Column, q: float) -> Column:
    return F.greatest(q * error, (q - 1) * error)


def bound(value: Column, body) -> Column:
    """`body(value)` with `value` computed once instead of once per mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter (anonymous computus) as one expression."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    epact = (19 * a + b - F.floor(b / 4) - F.floor((b - F.floor((b + 8) / 25) + 1) / 3) + 15) % 30

    def from_epact(h: Column) -> Column:
        weekday = (32 + 2 * (b % 4) + 2 * F.floor(c / 4) - h - c % 4) % 7

        def from_weekday(ell: Column) -> Column:
            late = F.floor((a + 11 * h + 22 * ell) / 451)
            return F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(22)), (h + ell - 7 * late).cast("int"))

        return bound(weekday, from_weekday)

    return bound(epact, from_epact)
