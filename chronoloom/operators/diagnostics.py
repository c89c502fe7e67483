"""Series diagnostics as data: correlation, binned counts, (partial) autocorrelation, decomposition, rolling stats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.frame import attach, by_time, whole, with_position
from chronoloom.operators.missing import fill_forward
from chronoloom.operators.timegrid import fill_calendar

# Rows in one seasonal cycle of each bucket level.
CYCLE = {"daily": 7, "weekly": 52, "monthly": 12}

PAIRS_AT_ONCE = 136  # pairs of columns in one aggregate
KEYS_AT_ONCE = 64  # keys whose cross products a task holds


def pair_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL when either one does not vary.

    The built-in `corr` raises on zero variance in ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlation_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, corr) for every ordered pair, using the rows where both values are present.

    Few columns are one aggregate of pairs; many are one pass of masked cross products (`wide_correlations`). Neither
    multiplies a row.
    """
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    if len(pairs) > PAIRS_AT_ONCE:
        return wide_correlations(df, cols, keys)
    data = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    one = data.groupBy(*keys).agg(*[pair_correlation(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for x, y in sorted({(a, b), (b, a)}):
            rows.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"p{i}").alias("corr")))
    return one.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


class PairSums:
    """Sums over the rows where two columns are both present, for all pairs of columns: rows, values, squares, products.

    Values count from `origin` (per column, about the mean of the first rows seen), so a common level costs no digits and a
    constant column has exactly no spread.
    """

    def __init__(self, x: np.ndarray):
        known = np.isfinite(x)
        first = np.where(known.any(axis=0), x[np.argmax(known, axis=0), np.arange(x.shape[1])], 0.0)
        rest = np.where(known, x - first, 0.0)
        self.origin = first + rest.sum(axis=0) / np.maximum(known.sum(axis=0), 1)
        x, mask = np.where(known, x - self.origin, 0.0), known.astype(float)
        self.rows, self.values, self.squares, self.products = mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x

    @classmethod
    def unpacked(cls, flat: np.ndarray, size: int) -> PairSums:
        one = cls.__new__(cls)
        one.origin = flat[:size]
        one.rows, one.values, one.squares, one.products = flat[size:].reshape(4, size, size)
        return one

    def packed(self) -> np.ndarray:
        return np.concatenate([self.origin, *(m.ravel() for m in (self.rows, self.values, self.squares, self.products))])

    def add(self, other: PairSums) -> None:
        """`other` is moved to this origin; a column not seen here before takes the other's origin."""
        unseen = np.diag(self.rows) == 0
        self.origin = np.where(unseen, other.origin, self.origin)
        by = np.where(np.diag(other.rows) == 0, 0.0, other.origin - self.origin)
        n, v = other.rows, other.values
        self.rows = self.rows + n
        self.products = self.products + other.products + by[:, None] * v.T + v * by[None, :] + np.outer(by, by) * n
        self.squares = self.squares + other.squares + 2 * by[:, None] * v + (by * by)[:, None] * n
        self.values = self.values + v + by[:, None] * n

    def correlations(self) -> np.ndarray:
        """NaN where a column of the pair doesn't vary over the pair's rows."""
        with np.errstate(all="ignore"):
            n, mean = self.rows, self.values / self.rows
            square = self.squares / n
            spread = square - mean * mean
            spread = np.where(spread > 1e-14 * square, spread, np.nan)
            corr = (self.products / n - mean * mean.T) / np.sqrt(spread * spread.T)
        return np.where(np.isfinite(corr), np.clip(corr, -1.0, 1.0), np.nan)


def wide_correlations(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, corr) of many columns in one pass: tasks sum masked cross products over their Arrow batches.

    Four sums a pair and task leave the tasks, whatever the number of rows; at most KEYS_AT_ONCE keys are held. Missing and
    infinite values count as absent; a pair without spread has NULL. An empty table gives no rows.
    """
    cols, keys = list(cols), list(keys)
    size = len(cols)
    data = df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"__c{i}") for i, c in enumerate(cols)])
    part = T.StructType([*[df.schema[k] for k in keys], T.StructField("__sums", T.ArrayType(T.DoubleType()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[PairSums, pa.RecordBatch]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for one, row in held.values():
                flat = pa.array([one.packed()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*row.columns, flat], names=[*keys, "__sums"])
            held.clear()

        for batch in batches:
            x = np.column_stack([batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in range(size)])
            named = batch.select(keys)
            groups = {(): np.arange(batch.num_rows)} if batch.num_rows else {}
            if keys:
                groups = pd.DataFrame({i: _codes(named.column(i)) for i in range(len(keys))}).groupby(list(range(len(keys)))).indices
            for at in groups.values():
                name = tuple(named.column(i)[int(at[0])].as_py() for i in range(len(keys)))
                fresh = PairSums(x[at])
                if name in held:
                    held[name][0].add(fresh)
                else:
                    held[name] = (fresh, named.slice(int(at[0]), 1))
            if len(held) > KEYS_AT_ONCE:
                yield from out()
        yield from out()

    whole_schema = T.StructType([
        *[df.schema[k] for k in keys], T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("corr", T.DoubleType())])

    def merged(table: pa.Table) -> pa.Table:
        parts = [PairSums.unpacked(np.asarray(p.values, dtype=float), size) for p in table.column("__sums")]
        for other in parts[1:]:
            parts[0].add(other)
        corr = parts[0].correlations().ravel()
        same = pa.array(np.zeros(size * size, np.int64))
        return pa.table([
            *[table.column(k).take(same) for k in keys], pa.array(np.repeat(cols, size).tolist()), pa.array(np.tile(cols, size).tolist()),
            pa.array(corr, mask=np.isnan(corr))], names=whole_schema.names)

    return data.mapInArrow(sums, part).groupBy(*keys).applyInArrow(merged, whole_schema)


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where values are, NULL being a value."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def varying(corr: DataFrame) -> DataFrame:
    """Drops the pairs of constant columns (their correlation is undefined)."""
    return corr.filter(F.col("corr").isNotNull())


def correlation_columns(
    columns: Sequence[str],
    target: str,
    *,
    lags: bool = False,
    extra: Sequence[str] = (),
    engineered: bool = True,
    holidays: bool = False,
    date_parts: Sequence[str] = (),
) -> list[str]:
    """Column choice of the two correlation reports: target with its lags, or target with exogenous and engineered."""
    if lags:
        return [target] + [c for c in columns if "lag" in c]
    chosen = [target, *extra]
    if engineered:
        chosen += [c for c in columns if "mean_" in c] + [c for c in columns if "median_" in c]
        chosen += ["holidays_fe"] if holidays else []
        chosen += list(date_parts)
    return [c for c in dict.fromkeys(chosen) if c in columns]


def binned_counts(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """Counts on a `bins` x `bins` grid over the value ranges; the top edge belongs to the last bin."""
    limits = df.groupBy(*keys).agg(
        F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1")
    )
    placed = attach(df.select(*keys, x, y).dropna(), limits, keys)

    def cell(v, lo, hi):
        share = F.coalesce(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
        return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")

    return (
        placed.withColumns({"bin_x": cell(x, "__x0", "__x1"), "bin_y": cell(y, "__y0", "__y1")})
        .groupBy(*keys, "bin_x", "bin_y")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def hexagon_counts(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), across: int = 20) -> DataFrame:
    """(keys, hex_x, hex_y, mid_x, mid_y, rows): counts in hexagons, `across` of them over the range of x.

    Hexagon centres are two lattices, the second shifted by half a cell both ways; a point belongs to the nearer of the two
    centres of the cell it is in (the second one on a tie). hex_x and hex_y are in half cells, mid_x and mid_y in the units
    of x and y. The upper edges belong to the last cells. Rows with a missing value are left out; a variable without spread is at 0.
    """
    up = int(across / 3**0.5)  # rows of regular hexagons in a square picture
    limits = df.groupBy(*keys).agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1"))
    placed = attach(df.select(*keys, x, y).dropna(), limits, keys)

    def along(v, lo, hi, cells):
        return F.coalesce(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0)) * cells

    def off(a, b):
        return (F.col("__u") - a) * (F.col("__u") - a) + 3 * (F.col("__v") - b) * (F.col("__v") - b)

    placed = placed.withColumns({"__u": along(x, "__x0", "__x1", across), "__v": along(y, "__y0", "__y1", up)})
    straight = [F.floor(F.col(c) + 0.5).cast("double") for c in ("__u", "__v")]
    shifted = [F.least(F.floor(F.col(c)), F.lit(cells - 1)) + F.lit(0.5) for c, cells in (("__u", across), ("__v", up))]
    first = off(*straight) < off(*shifted)
    cell = {n: (F.when(first, a).otherwise(b) * 2).cast("int") for n, a, b in zip(("hex_x", "hex_y"), straight, shifted)}
    limit = ["__x0", "__x1", "__y0", "__y1"]
    counts = placed.withColumns(cell).groupBy(*keys, *limit, "hex_x", "hex_y").agg(F.count(F.lit(1)).alias("rows"))
    mid = {
        "mid_x": F.col("__x0") + (F.col("__x1") - F.col("__x0")) * F.col("hex_x") / (2.0 * across),
        "mid_y": F.col("__y0") + (F.col("__y1") - F.col("__y0")) * F.col("hex_y") / (2.0 * up),
    }
    return counts.withColumns(mid).select(*keys, "hex_x", "hex_y", "mid_x", "mid_y", "rows")


def scatter_points(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Raw points; `binned_counts` is the table for a series with too many of them to draw."""
    return df.select(*keys, x, y)


def autocorrelation(
    df: DataFrame, var: str, max_lag: int, keys: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """(keys, lag, acf, bound) for lags 0..max_lag with the +-1.96/sqrt(n) band.

    The lagged products are window columns summed in one aggregate, so no row is ever multiplied.
    """
    w, w0 = by_time(keys, date), whole(keys)
    base = df.filter(F.col(var).isNotNull())
    base = base.withColumn("__c", F.col(var) - F.avg(var).over(w0))
    prods = {f"__l{k}": F.col("__c") * F.lag("__c", k).over(w) for k in range(max_lag + 1)}
    sums = [F.sum(f"__l{k}").alias(f"__l{k}") for k in range(max_lag + 1)]
    one = base.withColumns(prods).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sums)
    cells = [
        F.struct(
            F.lit(k).alias("lag"),
            F.try_divide(F.col(f"__l{k}"), F.col("__l0")).alias("acf"),
            (1.96 / F.sqrt("__n")).alias("bound"),
        )
        for k in range(max_lag + 1)
    ]
    out = one.select(*keys, F.explode(F.array(*cells)).alias("r")).select(*keys, "r.*")
    return out.filter(F.col("acf").isNotNull())


def partial_autocorrelation(
    df: DataFrame, var: str, max_lag: int, keys: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """(keys, lag, pacf, bound): Yule-Walker solutions by the Durbin-Levinson recursion over the acf array."""
    acf = autocorrelation(df, var, max_lag, keys, date)
    arr = acf.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("r"),
        F.first("bound").alias("bound"),
    )
    recursion = F.expr(
        """
        aggregate(
          sequence(1, size(r) - 1),
          struct(cast(array() as array<double>) as phi, cast(array() as array<double>) as out),
          (s, k) -> transform(
            array(try_divide(
              r[k] - aggregate(zip_with(s.phi, reverse(slice(r, 2, size(s.phi))), (a, b) -> a * b), 0d, (t, x) -> t + x),
              1 - aggregate(zip_with(s.phi, slice(r, 2, size(s.phi)), (a, b) -> a * b), 0d, (t, x) -> t + x))),
            f -> struct(
              concat(zip_with(s.phi, reverse(s.phi), (a, b) -> a - f * b), array(f)) as phi,
              concat(s.out, array(f)) as out))[0],
          s -> s.out)
        """
    )
    values = arr.filter(F.size("r") > 1).select(*keys, "bound", F.posexplode(recursion).alias("__i", "pacf"))
    return values.select(*keys, (F.col("__i") + 1).cast("int").alias("lag"), "pacf", "bound")


def decompose(
    df: DataFrame,
    var: str,
    level: str,
    keys: Sequence[str] = (),
    date: str = "date",
    period: int | None = None,
    regularize: bool = True,
) -> DataFrame:
    """(keys, date, observed, trend, seasonal, resid): additive decomposition by centred moving average.

    Keys with fewer than two full cycles give no rows. Gaps are carried forward first when `regularize` is on.
    """
    p = period or CYCLE[level]
    base = df.select(*keys, date, F.col(var).cast("double").alias("observed")).dropna(subset=["observed"])
    if regularize:
        base = fill_forward(fill_calendar(base, level=level, keys=keys, date=date), ["observed"], keys, date)
    w = by_time(keys, date)
    base = with_position(base, keys, date).filter(F.col("__rows") >= 2 * p)
    half = p // 2
    if p % 2:
        total = F.sum("observed").over(w.rowsBetween(-half, half)) / p
    else:
        inner = F.sum("observed").over(w.rowsBetween(-half + 1, half - 1))
        edge = F.lag("observed", half).over(w) + F.lead("observed", half).over(w)
        total = (inner + 0.5 * edge) / p
    full = (F.col("__row") > half) & (F.col("__row") <= F.col("__rows") - half)
    base = base.withColumns({"trend": F.when(full, total), "__phase": ((F.col("__row") - 1) % p).cast("int")})
    base = base.withColumn("__off", F.col("observed") - F.col("trend"))
    w0 = whole(keys)
    phase_means = [F.avg(F.when(F.col("__phase") == i, F.col("__off"))).over(w0) for i in range(p)]
    base = base.withColumn("__means", F.array(*phase_means))
    centre = F.aggregate("__means", F.lit(0.0), lambda s, x: s + x) / p
    base = base.withColumn("seasonal", F.element_at("__means", F.col("__phase") + 1) - centre)
    return base.select(
        *keys, date, "observed", "trend", "seasonal", (F.col("__off") - F.col("seasonal")).alias("resid")
    )


def rolling_stats(
    df: DataFrame, var: str, keys: Sequence[str] = (), date: str = "date", rows: int = 6
) -> DataFrame:
    """Mean and sample deviation of the last `rows` rows; NULL until the window is full of values."""
    w = by_time(keys, date).rowsBetween(-(rows - 1), 0)
    full = F.count(var).over(w) == rows
    return df.select(
        *keys,
        date,
        var,
        F.when(full, F.avg(var).over(w)).alias("rolling_mean"),
        F.when(full, F.stddev_samp(var).over(w)).alias("rolling_std"),
    )


def difference_evolution(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """(keys, date, difference[, secdifference]) of a frame that went through `differences`."""
    return df.select(*keys, date, *[c for c in ("difference", "secdifference") if c in df.columns])


def value_counts(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("times"))


def column_mode(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value; the smallest one on ties. Counts first, so no group ever holds its distinct values."""
    counts = value_counts(df.filter(F.col(col).isNotNull()), col, keys)
    return counts.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("times"), F.col(col))).alias("mode"))


def row_minimum(df: DataFrame, cols: Sequence[str], name: str = "row_min") -> DataFrame:
    return df.withColumn(name, F.least(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0]))

