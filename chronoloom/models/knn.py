"""k nearest neighbours: forecasts by native expressions, parameter search by blocked distances."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.backtest import contiguous_fold
from chronoloom.operators.frame import attach, join_keys, whole, with_step
from chronoloom.operators.transforms import unbounded_before
from chronoloom.session import cut_lineage

# The parameter search grid.
KNN_GRID = {"n_neighbors": [3, 5, 9], "weights": ["uniform", "distance"], "p": [1, 2]}
CHUNK = 256  # most rows per block of the search; bounds the memory of one task
LEAST = 64  # and the fewest, but in a fold's last block
FIRST = 512  # rows of other folds that a block meets whatever the pivots say
PIVOTS = 16  # rows of a key to which all others are measured


def _distance(xs: Column, os: Column, on: Column, features: Sequence[str], power: Column | int) -> Column:
    """Minkowski distance over the columns that vary in the origin's history, as a plain sum expression."""
    gaps = [F.when(on[i], F.abs(xs[i] - os[i])).otherwise(F.lit(0.0)) for i in range(len(features))]
    city, square = F.lit(0.0), F.lit(0.0)
    for g in gaps:
        city, square = city + g, square + g * g
    if isinstance(power, int):
        return city if power == 1 else F.sqrt(square)
    return F.when(power == 1, city).otherwise(F.sqrt(square))


def knn_forecasts(
    df: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    k: int = 5,
    weights: str = "uniform",
    p: int = 2,
    params: DataFrame | None = None,
    max_k: int | None = None,
    name: str = "knn",
) -> DataFrame:
    """Average target of the k complete earlier rows nearest to each origin; ties go to the older row.

    Every history row meets the `horizon` origins of its key through an array column, so there is no self join and
    no shuffle beyond the keys' own. `params` (from `knn_search`) gives k, weights and p per key; pass the largest
    possible k as `max_k` with it.
    """
    base = df.select(*keys, date, F.col(target).cast("double").alias("__y"), *features)
    base = with_step(base, keys, horizon, date)
    before = unbounded_before(keys, date)
    x = F.array(*[F.col(c).cast("double") for c in features])
    on = F.array(*[F.coalesce(F.min(c).over(before) < F.max(c).over(before), F.lit(False)) for c in features])
    base = base.withColumns({"__x": x, "__on": on}).drop(*features)
    usable = ~F.exists("__x", lambda v: v.isNull() | F.isnan(v))
    origin = F.struct("__row", "step", F.col(date).alias("date"), F.col("__x").alias("x"), F.col("__on").alias("on"))
    base = base.withColumn("__usable", usable)
    base = base.withColumn(
        "__origins", F.collect_list(F.when(F.col("step").isNotNull() & F.col("__usable"), origin)).over(whole(keys))
    )
    if params is not None:
        base = attach(base, params, keys)
        width, kk, ww, pp = int(max_k or max(KNN_GRID["n_neighbors"])), F.col("n_neighbors"), F.col("weights"), F.col("p")
    else:
        width, kk, ww, pp = k, F.lit(k), F.lit(weights), p
    extra = ["n_neighbors", "weights", "p"] if params is not None else []
    history = base.filter(F.col("__usable") & F.col("__y").isNotNull()).select(
        *keys, "__row", "__y", "__x", *extra, F.explode("__origins").alias("o")
    )
    pairs = history.filter(F.col("__row") < F.col("o.__row")).select(
        *keys,
        F.col("o.step").alias("step"),
        F.col("o.date").alias("date"),
        "__y",
        "__row",
        *extra,
        _distance(F.col("__x"), F.col("o.x"), F.col("o.on"), features, pp).alias("d"),
    )
    near = Window.partitionBy(*keys, "step", "date").orderBy("d", "__row")
    top = pairs.withColumn("__rank", F.row_number().over(near)).filter(F.col("__rank") <= width)
    top = top.filter(F.col("__rank") <= kk)
    hit = F.count_if(F.col("d") == 0)
    plain = F.avg("__y")
    inverse = F.when(hit > 0, F.avg(F.when(F.col("d") == 0, F.col("__y")))).otherwise(
        F.try_divide(F.sum(F.try_divide("__y", "d")), F.sum(F.try_divide(F.lit(1.0), F.col("d"))))
    )
    kind = F.first(ww) if params is not None else ww
    return top.groupBy(*keys, "step", "date").agg(
        F.lit(name).alias("model"), F.when(kind == "distance", inverse).otherwise(plain).alias("pred")
    )


def _block_neighbours(ids: Sequence[str], powers: Sequence[int], most: int, names: Sequence[str]):
    """For one pair of row blocks: each left row's nearest right rows, per power."""

    def flat(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
        return batch.column(name)[i].values.to_numpy(zero_copy_only=False)

    def rows(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
        values = batch.column(name)[i].values
        return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lx, rx = rows(batch, "lx", i), rows(batch, "rx", i)
                ry, rr = flat(batch, "ry", i), flat(batch, "rr", i)
                for power in powers:
                    gap = np.zeros((len(lx), len(rx)))
                    for j in range(lx.shape[1]):
                        diff = np.abs(lx[:, j, None] - rx[None, :, j])
                        gap += diff if power == 1 else diff * diff
                    gap = gap if power == 1 else np.sqrt(gap)
                    take = np.argsort(gap, axis=1, kind="stable")[:, :most]
                    near = np.take_along_axis(gap, take, axis=1)
                    good = np.isfinite(near)
                    cells = pa.StructArray.from_arrays(
                        [pa.array(near[good]), pa.array(rr[take[good]].astype(np.int64)), pa.array(ry[take[good]].astype(float))], names=["d", "__row", "y"])
                    ends = np.r_[0, np.cumsum(good.sum(axis=1))].astype(np.int32)
                    same = pa.array(np.full(len(lx), i))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(n).take(same) for n in [*ids, "fold", "chunk"]), pa.array(np.full(len(lx), power, np.int32)),
                         pa.array(flat(batch, "lr", i).astype(np.int64)), pa.array(flat(batch, "ly", i).astype(float)),
                         pa.ListArray.from_arrays(pa.array(ends), cells)], names=list(names))

    return run


def _pivot_distances(x: Column, power: int) -> Column:
    """Distances of a row to its key's pivots."""

    def one(pivot: Column) -> Column:
        gaps = F.zip_with(pivot, x, lambda a, b: F.abs(a - b))
        if power == 1:
            return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g))

    return F.transform("__pivots", one)


def _fold_blocks(rows: DataFrame, ids: Sequence[str], powers: Sequence[int]) -> DataFrame:
    """(ids, fold, chunk, size, cells, near<power>): the rows (r, fold, y, x) of a fold in blocks of rows alike.

    Pivots are rows at even ranks of the features' sum. Rows are ordered by their nearest pivot and the distance to it, and
    cut into blocks of twice the square root of the fold, between LEAST and CHUNK; `near<power>` has a block's least and largest
    distance to each pivot.
    """
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy(total, "r")).cast("long") - 1
    count = F.count(F.lit(1)).over(whole(ids))
    ranked = rows.withColumns({"__rank": rank, "__of": count})
    chosen = F.pmod(F.col("__rank") * PIVOTS + F.floor(F.col("__of") / 2), F.col("__of")) < PIVOTS
    ranked = ranked.withColumn("__pivots", F.array_sort(F.collect_list(F.when(chosen, F.col("x"))).over(whole(ids))))
    placed = ranked.withColumns({f"__d{p}": _pivot_distances(F.col("x"), p) for p in powers}).drop("__pivots", "__rank", "__of")
    first = F.col(f"__d{powers[0]}")
    order = Window.partitionBy(*ids, "fold").orderBy(F.array_position(first, F.array_min(first)), F.array_min(first), "r")
    root = F.ceil(2 * F.sqrt(F.count(F.lit(1)).over(Window.partitionBy(*ids, "fold"))))
    size = F.greatest(F.lit(LEAST), F.least(F.lit(CHUNK), root))
    placed = placed.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / size).cast("int"))

    def span(p: int) -> Column:
        at = [F.get(f"__d{p}", F.lit(j)) for j in range(PIVOTS)]
        return F.array(*[F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")) for d in at]).alias(f"near{p}")

    return placed.groupBy(*ids, "fold", "chunk").agg(
        F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("r", "y", "x"))).alias("cells"), *[span(p) for p in powers]
    )


class FoldNeighbours(NamedTuple):
    """Nearest rows of other folds: `near` (ids, fold, p, r, y, near), the block pairs `met` for it and all that there are."""

    near: DataFrame
    met: DataFrame
    possible: DataFrame


def fold_neighbours(rows: DataFrame, ids: Sequence[str], powers: Sequence[int], most: int) -> FoldNeighbours:
    """The `most` nearest rows outside its own fold of every row of `rows` (ids, r, fold, y, x), exactly; ties to the smaller r.

    A block first meets the blocks that the pivots show to be close, with at least FIRST rows and enough to fill its lists. The farthest neighbour
    found is its reach, and of the other blocks it meets those to which the pivots don't show a greater distance: by the
    triangle inequality, rows whose distances to one pivot differ by t are at least t apart.
    """
    ids, powers = list(ids), list(powers)
    blocks = cut_lineage(_fold_blocks(rows, ids, powers))
    here = blocks.select(*ids, "fold", "chunk", *[F.col(f"near{p}").alias(f"l{p}") for p in powers])
    there = blocks.select(*ids, F.col("fold").alias("fold2"), F.col("chunk").alias("chunk2"), "size", *[F.col(f"near{p}").alias(f"r{p}") for p in powers])

    def apart(p: int) -> Column:  # less what rounding can add
        gap = F.zip_with(f"l{p}", f"r{p}", lambda u, v: F.greatest(u["lo"] - v["hi"], v["lo"] - u["hi"]) - 1e-9 * (u["hi"] + v["hi"]))
        return F.nanvl(F.array_max(gap), F.lit(0.0)).alias(f"apart{p}")

    within = F.array_min(F.zip_with(f"l{powers[0]}", f"r{powers[0]}", lambda u, v: u["hi"] + v["hi"]))
    possible = join_keys(here, there, ids).filter(F.col("fold") != F.col("fold2"))
    possible = possible.select(*ids, "fold", "chunk", "fold2", "chunk2", "size", within.alias("within"), *[apart(p) for p in powers])
    closest = Window.partitionBy(*ids, "fold", "chunk").orderBy("within", "fold2", "chunk2")
    before = F.coalesce(F.sum("size").over(closest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    possible = possible.withColumn("first", before < max(most, FIRST))

    left = blocks.select(*ids, "fold", "chunk", *[F.col(f"cells.{c}").alias(f"l{c}") for c in "ryx"])
    right = blocks.select(*ids, F.col("fold").alias("fold2"), F.col("chunk").alias("chunk2"), *[F.col(f"cells.{c}").alias(f"r{c}") for c in "ryx"])
    cell = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("__row", T.LongType()), T.StructField("y", T.DoubleType())])
    schema = T.StructType(
        [blocks.schema[c] for c in [*ids, "fold", "chunk"]]
        + [T.StructField("p", T.IntegerType()), T.StructField("r", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("near", T.ArrayType(cell))]
    )

    def met(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(*ids, "fold", "chunk", "fold2", "chunk2")
        both = join_keys(join_keys(pairs, left, [*ids, "fold", "chunk"]), right, [*ids, "fold2", "chunk2"])
        return both.mapInArrow(_block_neighbours(ids, powers, most, schema.names), schema)

    def best(found: DataFrame) -> DataFrame:
        kept = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most).alias("near")
        return found.groupBy(*ids, "fold", "chunk", "p", "r", "y").agg(kept)

    start = cut_lineage(best(met(possible.filter("first"))))
    farthest = F.when(F.size("near") < most, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"])
    reach = start.groupBy(*ids, "fold", "chunk").agg(*[F.max(F.when(F.col("p") == p, farthest)).alias(f"reach{p}") for p in powers])
    rest = join_keys(possible.filter(~F.col("first")), reach, [*ids, "fold", "chunk"])
    some = F.lit(False)
    for p in powers:
        some = some | (F.col(f"apart{p}") <= F.col(f"reach{p}"))
    rest = rest.filter(some)
    near = best(start.unionByName(met(rest))).drop("chunk")
    names = [*ids, "fold", "chunk", "fold2", "chunk2"]
    return FoldNeighbours(near, possible.filter("first").select(names).unionByName(rest.select(names)), possible.select(names))


def knn_search(
    df: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    grid: Mapping[str, Sequence] = KNN_GRID,
    folds: int = 3,
    tune_on: str = "newest",
) -> DataFrame:
    """(keys, n_neighbors, weights, p) with the lowest mean squared error over contiguous folds.

    Exact search (`fold_neighbours`): blocks of rows alike meet only where pivots don't rule it out and keep only the nearest
    rows of each block, so neither a whole key nor its row pairs are ever held or shuffled.
    """
    most = max(grid["n_neighbors"])
    base = with_step(df.select(*keys, date, target, *features), keys, horizon, date)
    full = F.lit(True)
    for c in (target, *features):
        full = full & F.col(c).isNotNull()
    member = full & (F.col("__row") < F.col("__rows") if tune_on == "newest" else F.col("step").isNull())
    rows = base.withColumn("__fold", contiguous_fold(member, folds, keys, date)).filter(F.col("__fold").isNotNull())
    ids = [f"k{i}" for i in range(len(keys))]
    rows = rows.select(
        *[F.col(c).alias(i) for c, i in zip(keys, ids)], F.col("__row").cast("long").alias("r"), F.col("__fold").cast("int").alias("fold"),
        F.col(target).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
    )
    found = fold_neighbours(rows, ids, list(grid["p"]), most).near
    merged = found.select(*[F.col(i).alias(c) for c, i in zip(keys, ids)], "p", F.col("r").alias("__row"), "fold", "y", "near")
    scores = []
    i = 0
    for k in grid["n_neighbors"]:
        for weight in grid["weights"]:
            scores.append(
                F.struct(F.lit(i).alias("i"), F.lit(k).alias("n_neighbors"), F.lit(weight).alias("weights"),
                         _neighbour_mean(F.slice("near", 1, k), weight).alias("pred"))
            )
            i += 1
    tried = merged.select(*keys, "p", "fold", "y", F.explode(F.array(*scores)).alias("c"))
    mse = tried.groupBy(*keys, "p", "fold", "c.i", "c.n_neighbors", "c.weights").agg(
        F.avg((F.col("y") - F.col("c.pred")) ** 2).alias("mse")
    )
    mean = mse.groupBy(*keys, "p", "i", "n_neighbors", "weights").agg(F.avg("mse").alias("mse"))
    best = mean.groupBy(*keys).agg(
        F.min_by(F.struct("n_neighbors", "weights", "p"), F.struct("mse", "i", "p")).alias("b")
    )
    return best.select(*keys, "b.*")


def _neighbour_mean(near: Column, weights: str) -> Column:
    zero = F.lit(0.0)
    ys = F.transform(near, lambda s: s["y"])
    plain = F.try_divide(F.aggregate(ys, zero, lambda a, v: a + v), F.size(near))
    if weights == "uniform":
        return plain
    same = F.filter(near, lambda s: s["d"] == 0)
    exact = F.try_divide(F.aggregate(same, zero, lambda a, s: a + s["y"]), F.size(same))
    top = F.aggregate(near, zero, lambda a, s: a + F.coalesce(F.try_divide(s["y"], s["d"]), zero))
    bottom = F.aggregate(near, zero, lambda a, s: a + F.coalesce(F.try_divide(F.lit(1.0), s["d"]), zero))
    return F.when(F.size(same) > 0, exact).otherwise(F.try_divide(top, bottom))
