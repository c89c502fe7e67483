"""Repairs on freshly read tables: repeated headers, number formats, typing and column roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions.columns import european_number, european_percent, null_if_nan
from chronoloom.operators.frame import numeric_columns

# Configuration names of the number-format repairs.
NUMBER_FIXES = {"european_format": european_number, "pct_european": european_percent}


def drop_header_rows(df: DataFrame, target: str) -> DataFrame:
    """Removes rows whose target cell repeats the column's own name."""
    return df.filter(~F.col(target).cast("string").eqNullSafe(F.lit(target)))


def fix_numbers(df: DataFrame, issues: Sequence[tuple[str, str]]) -> DataFrame:
    new = {c: NUMBER_FIXES[issue](c) for c, issue in issues if issue in NUMBER_FIXES}
    return df.withColumns(new) if new else df


def numeric_text_columns(df: DataFrame, candidates: Sequence[str] | None = None) -> list[str]:
    """Text columns in which every non-null value parses as a number, found by one aggregate row."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    text = [c for c in text if candidates is None or c in candidates]
    if not text:
        return []
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in text]
    counts = df.agg(*bad).first()
    return [c for c in text if counts[c] == 0]


def coerce_numeric(df: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """Casts the all-numeric text columns to double, and turns NaN into NULL in floating columns."""
    new = {c: F.col(c).try_cast("double") for c in numeric_text_columns(df, candidates)}
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    new |= {c: null_if_nan(c) for c in floats}
    df = df.withColumns(new) if new else df
    text = [c for c in new if c not in floats]
    return df.withColumns({c: null_if_nan(c) for c in text}) if text else df


def prune_columns(
    df: DataFrame,
    mode: str,
    *,
    ts: str,
    target: str,
    categoric: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Columns by analysis mode: `ts_only` = time and target; `ts_numeric` = those plus numeric columns that are
    not listed as categoric; any other mode keeps everything."""
    if mode == "ts_only":
        return df.select(*dict.fromkeys([*keys, ts, target]))
    if mode == "ts_numeric":
        numbers = [c for c in numeric_columns(df, exclude=[target, ts, *keys]) if c not in categoric]
        return df.select(*dict.fromkeys([*keys, ts, target, *numbers]))
    return df
