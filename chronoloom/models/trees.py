"""Forests and boosted trees pooled over all keys, grown level by level for all origins, folds and candidates at once.

Features become bin numbers once. A level is one Spark job: tasks let their rows fall through the trees as they stand and
sum, for every tree, open node, feature and bin, the rows and targets that arrive; these histograms are added by tree, and a
tree's splits come from prefix sums over the bins. To the driver come the splits alone, which is the model. Rows never move.
A row with a missing feature goes to the side that fits better, chosen at each split.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.backtest import contiguous_fold
from chronoloom.operators.frame import whole, with_step
from chronoloom.session import cut_lineage

# Output names.
TREE_MODELS = {"rf": "rf", "gbt": "xgb"}
DEEPEST = 30  # stands for "no depth limit"
BINS = 63  # bins of a feature; one more holds what is missing
AT_ONCE = 512  # trees that grow side by side
FOLDED = 10  # boosting rounds after which a row's fit so far is written down
EVERY = np.iinfo(np.int32).max  # the origin of a model that may see all rows


def _depth(value) -> int:
    if value in (None, "None", "null"):
        return DEEPEST
    if int(value) > DEEPEST:
        raise ValueError(f"max_depth {value} is above the limit of {DEEPEST}")
    return int(value)


def _subset(value) -> str:
    if value in (None, "None", "null"):
        return "all"
    return str(value)


@dataclass(frozen=True)
class TreeSettings:
    """What a model is grown by. A split needs `min_samples_split` rows, so each side at least half of them."""

    trees: int = 20
    depth: int = 5
    subset: str = "auto"
    least: int = 1
    rate: float = 0.1

    @classmethod
    def of(cls, kind: str, params: Mapping) -> TreeSettings:
        out = {}
        for key, value in params.items():
            if key == "n_estimators":
                out["trees"] = int(value)
            elif key == "max_depth":
                out["depth"] = _depth(value)
            elif key in ("max_features", "colsample_bytree"):
                out["subset"] = _subset(value)
            elif key == "min_samples_split":
                out["least"] = max(int(value) // 2, 1)
            elif key == "learning_rate":
                out["rate"] = float(value)
            else:
                raise ValueError(f"{key!r} is not a parameter of these trees")
        made = cls(**out)
        made.features(kind, 10)
        return made

    def features(self, kind: str, p: int) -> int:
        """How many of `p` features a node may split on."""
        named = {"all": p, "auto": -(-p // 3) if kind == "rf" else p, "onethird": -(-p // 3), "sqrt": int(np.ceil(np.sqrt(p))), "log2": int(np.ceil(np.log2(p))) if p > 1 else 1}
        if self.subset in named:
            return max(1, min(p, named[self.subset]))
        share = float(self.subset)  # a name that isn't known raises here
        return max(1, min(p, int(np.ceil(share * p)) if share <= 1 and "." in self.subset else int(share)))


@dataclass
class Tree:
    """A growing tree: for each node its split (feature < 0: none), children and mean target."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    lost_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int16), np.array(self.bin, np.uint8), np.array(self.lost_left), np.array(self.left, np.int32), np.array(self.value))

    def split(self, found: Mapping[int, tuple], least: int, last: bool) -> None:
        """Splits of the open nodes by place: (feature, bin, missing to the left, value, rows and values of both sides)."""
        after = []
        for place, node in enumerate(self.open):
            if place not in found:
                continue
            feature, edge, lost, value, n_left, n_right, v_left, v_right = found[place]
            self.value[node] = value
            if feature < 0:
                continue
            self.feature[node], self.bin[node], self.lost_left[node], self.left[node] = feature, edge, lost, len(self.value)
            for n, v in ((n_left, v_left), (n_right, v_right)):
                if n >= 2 * least and n > 1 and not last:
                    after.append(len(self.value))
                self.feature.append(-1), self.bin.append(0), self.lost_left.append(False), self.left.append(0), self.value.append(v)
        self.open = after


def fall(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node that each row of bin numbers arrives at."""
    feature, edge, lost_left, left, _ = tree
    node = np.zeros(len(bins), np.int32)
    at = np.arange(len(bins))
    while len(at):
        at = at[feature[node[at]] >= 0]
        here = node[at]
        b = bins[at, feature[here]]
        goes_left = np.where(b == BINS, lost_left[here], b <= edge[here])
        node[at] = left[here] + np.where(goes_left, 0, 1)
    return node


@dataclass(frozen=True)
class Job:
    """One tree to grow: which rows it may see (those before step `origin`, and none of fold `held`) and what was fitted before."""

    origin: int
    held: int
    seed: int  # 0: every row counts once
    place: int = -1  # of its model's fit in a row's array of fits
    base: float = 0.0
    rate: float = 0.0
    before: tuple = ()

    def rows(self, step: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return (step < self.origin) if self.held < 0 else (fold >= 0) & (fold != self.held)

    def fit(self, bins: np.ndarray, fits: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base) if self.place < 0 else fits[:, self.place].copy()
        for tree in self.before:
            out += self.rate * tree[4][fall(tree, bins)]
        return out


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))


def _times(uid: np.ndarray, seed: int) -> np.ndarray:
    """How often a tree of a forest draws each row: Poisson numbers from the row's hash, the same in every job."""
    x = uid.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53).astype(float)


class _Rows:
    """An Arrow batch of binned rows."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        self.bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, -1) if n else np.empty((0, 1), np.uint8)
        self.y = np.asarray(batch.column("__y").fill_null(np.nan), dtype=float)
        self.step = np.asarray(batch.column("step").fill_null(-1))
        self.fold = np.asarray(batch.column("fold").fill_null(-1))
        self.uid = np.asarray(batch.column("uid"))
        fits = batch.column("fits")
        self.fits = np.asarray(fits.flatten(), dtype=float).reshape(n, -1) if n and len(fits.flatten()) else np.empty((n, 0))


def _histograms(rows: DataFrame, jobs: Sequence[Job], trees: Sequence[Tree]) -> DataFrame:
    """(job, code, n, s): rows and targets by (open node, feature, bin) of each tree, summed per task."""
    state = [(job, tree.arrays(), np.array(tree.open)) for job, tree in zip(jobs, trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, out = _Rows(batch), []
            known = np.isfinite(r.y)
            wide = r.bins.shape[1] * (BINS + 1)
            places = np.arange(r.bins.shape[1]) * (BINS + 1)
            for i, (job, tree, frontier) in enumerate(state):
                at = np.flatnonzero(known & job.rows(r.step, r.fold))
                times = _times(r.uid[at], job.seed) if job.seed else np.ones(len(at))
                at, times = at[times > 0], times[times > 0]
                if not len(frontier) or not len(at):
                    continue
                node = fall(tree, r.bins[at])
                place = np.searchsorted(frontier, node).clip(max=len(frontier) - 1)
                here = frontier[place] == node
                at, times, place = at[here], times[here], place[here]
                if not len(at):
                    continue
                target = (r.y[at] - job.fit(r.bins[at], r.fits[at])) * times
                code = (place[:, None] * wide + places + r.bins[at]).ravel()
                p, size = r.bins.shape[1], len(frontier) * wide
                names = None
                if size > 1_000_000:  # many open nodes: only cells that are hit
                    names, code = np.unique(code, return_inverse=True)
                n, total = np.bincount(code, np.repeat(times, p)), np.bincount(code, np.repeat(target, p))
                if names is None:
                    names = np.flatnonzero(n)
                    n, total = n[names], total[names]
                out.append((i, names, n, total))
            ends = pa.array(np.cumsum([0, *(len(o[1]) for o in out)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([o[k] for o in out] or [np.empty(0)]), kind)) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *lists], names=["job", "code", "n", "s"])

    return rows.mapInArrow(run, "job int, code array<bigint>, n array<double>, s array<double>")


def best_splits(n: np.ndarray, s: np.ndarray, least: int, allowed: np.ndarray) -> list[tuple]:
    """For each node the split of largest gain, from (node, feature, bin) sums; the last bin holds what is missing."""
    rows, total = n[:, 0].sum(axis=1), s[:, 0].sum(axis=1)
    lost_n, lost_s = n[:, :, -1:], s[:, :, -1:]
    options = []
    with np.errstate(all="ignore"):
        for lost in (True, False):
            ln, ls = n[:, :, :-1].cumsum(axis=2) + lost * lost_n, s[:, :, :-1].cumsum(axis=2) + lost * lost_s
            rn, rs = rows[:, None, None] - ln, total[:, None, None] - ls
            gain = ls**2 / ln + rs**2 / rn - (total**2 / rows)[:, None, None]
            ok = (ln >= least - 1e-9) & (rn >= least - 1e-9) & (ln > 1e-9) & (rn > 1e-9) & allowed[:, :, None]
            options.append((np.where(ok, gain, -np.inf), ln, ls, rn, rs))
        gain, ln, ls, rn, rs = (np.stack(o, axis=1).reshape(len(n), -1) for o in zip(*options))
        pick = gain.argmax(axis=1)
        at = np.arange(len(n))
        side, feature, edge = np.unravel_index(pick, (2, *options[0][0].shape[1:]))
        ln, ls, rn, rs = ln[at, pick], ls[at, pick], rn[at, pick], rs[at, pick]
        value = np.where(rows > 0, total / rows, 0.0)
        none = ~(gain[at, pick] > 1e-12 * np.maximum(total**2 / np.maximum(rows, 1.0), 1e-12))
        left = np.where(lost_n[at, feature, 0] > 0, side == 0, ln >= rn)  # nothing missing seen: the larger side
        held = [np.where(none, 0.0, x) for x in (ln, rn, ls / ln, rs / rn)]
    columns = [at, np.where(none, -1, feature), np.where(none, 0, edge), left & ~none, value, *held]
    return list(zip(*(c.tolist() for c in columns)))


_SPLITS = "job int, place int, feature int, edge int, lost boolean, value double, n_left double, n_right double, v_left double, v_right double"


def grow(rows: DataFrame, jobs: Sequence[Job], settings: Sequence[TreeSettings], kind: str, width: int) -> list[Tree]:
    """One tree for each job, `AT_ONCE` side by side, one pass over the rows a level."""
    done: list[Tree] = []
    for a in range(0, len(jobs), AT_ONCE):
        some, own = jobs[a : a + AT_ONCE], settings[a : a + AT_ONCE]
        trees = [Tree() for _ in some]
        for level in range(max(s.depth for s in own)):
            live = [i for i, t in enumerate(trees) if t.open and level < own[i].depth]
            if not live:
                break
            least = np.array([own[i].least for i in live])
            take = np.array([own[i].features(kind, width) for i in live])
            held = [(some[i].seed * 1_000_003 + some[i].origin + 7 * some[i].held + 13 * len(some[i].before), np.array(trees[i].open)) for i in live]

            def choose(group: pa.Table) -> pa.Table:
                job = group["job"][0].as_py()
                code = np.concatenate([np.asarray(c.flatten()) for c in group["code"].chunks])
                n, s = (np.concatenate([np.asarray(c.flatten()) for c in group[x].chunks]) for x in "ns")
                seed, frontier = held[job]
                size = len(frontier) * width * (BINS + 1)
                n, s = (np.bincount(code, v, size).reshape(len(frontier), width, BINS + 1) for v in (n, s))
                order = np.stack([np.random.default_rng(abs(seed) * 31 + int(node)).permutation(width) for node in frontier])
                found = best_splits(n, s, int(least[job]), order < take[job])
                columns = list(zip(*[(job, *f) for f in found]))
                kinds = [pa.int32()] * 4 + [pa.bool_()] + [pa.float64()] * 5
                return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split(" ")[0] for x in _SPLITS.split(", ")])

            parts = _histograms(rows, [some[i] for i in live], [trees[i] for i in live])
            parts = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job")
            found: list[dict] = [{} for _ in live]
            for r in parts.groupBy("job").applyInArrow(choose, _SPLITS).collect():  # the model's own nodes
                found[r["job"]][r["place"]] = tuple(r)[2:]
            for i, f in zip(live, found):
                trees[i].split(f, own[i].least, last=level + 1 == own[i].depth)
            for i, t in enumerate(trees):
                if i not in live:
                    t.open = []
        done += trees
    return done


@dataclass
class Model:
    """The trees of one origin, or of one candidate without one fold."""

    origin: int
    held: int
    settings: TreeSettings
    base: float = 0.0
    trees: list[tuple] = field(default_factory=list)

    def predict(self, kind: str, bins: np.ndarray) -> np.ndarray:
        said = [t[4][fall(t, bins)] for t in self.trees]
        if kind == "rf":
            return np.mean(said, axis=0) if said else np.full(len(bins), np.nan)
        return self.base + self.settings.rate * np.sum(said, axis=0) if said else np.full(len(bins), self.base)


def fit_models(rows: DataFrame, models: list[Model], kind: str, width: int, seed: int) -> list[Model]:
    """All models side by side: a forest's trees at once, boosted trees round by round."""
    if kind == "rf":
        jobs = [(m, Job(m.origin, m.held, 1 + (seed * 7919 + t) % (2**31))) for m in models for t in range(m.settings.trees)]
        for (m, _), tree in zip(jobs, grow(rows, [j for _, j in jobs], [m.settings for m, _ in jobs], kind, width)):
            m.trees.append(tree.arrays())
        return models
    for m, tree in zip(models, grow(rows, [Job(m.origin, m.held, 0) for m in models], [TreeSettings(depth=1, least=2**40)] * len(models), kind, width)):
        m.base = tree.value[0]  # one level without a split: the mean
    folded = [0] * len(models)
    for turn in range(max((m.settings.trees for m in models), default=0)):
        live = [i for i, m in enumerate(models) if turn < m.settings.trees]
        if turn and turn % FOLDED == 0:
            rows, folded = _with_fits(rows, models), [len(m.trees) for m in models]
        jobs = [Job(m.origin, m.held, 0, i if folded[i] else -1, m.base, m.settings.rate, tuple(m.trees[folded[i] :])) for i, m in ((i, models[i]) for i in live)]
        for i, tree in zip(live, grow(rows, jobs, [models[i].settings for i in live], kind, width)):
            models[i].trees.append(tree.arrays())
    return models


def _with_fits(rows: DataFrame, models: list[Model]) -> DataFrame:
    """Rows with what every boosted model says so far."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _Rows(batch).bins
            fits = np.column_stack([m.predict("gbt", bins) for m in models]) if batch.num_rows else np.empty((0, len(models)))
            ends = pa.array(np.arange(0, fits.size + 1, len(models)).astype(np.int32))
            columns = [batch.column(c) if c != "fits" else pa.ListArray.from_arrays(ends, pa.array(fits.ravel(), pa.float64())) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut_lineage(rows.mapInArrow(run, rows.schema))


def _sized(df, target, features, horizon, keys, date) -> tuple[DataFrame, list[str]]:
    """Rows with `__y`, `__scale` and one double column per feature, and the names of these.

    All keys share one fit, so a key's target and its continuous features are divided by their mean size before the first
    origin: else the keys with the largest values would decide the loss. Whole-number features (calendar parts, counts)
    mean the same for all keys and stay.
    """
    base = with_step(df.select(*keys, date, F.col(target).cast("double").alias("__y"), *features), keys, horizon, date)
    kinds = dict(base.dtypes)

    def size(c: str):
        mean = F.avg(F.when(F.col("step").isNull(), F.abs(F.col(c)))).over(whole(keys))
        return F.when(mean > 0, mean).otherwise(F.lit(1.0))

    def sized(c: str):
        return F.col(c).cast("double") / size(c) if keys and kinds[c] in ("double", "float") else F.col(c).cast("double")

    base = base.withColumn("__scale", size("__y") if keys else F.lit(1.0))
    filled = {f"__f{i}": sized(c) for i, c in enumerate(features)}
    if keys:  # the key enters as its mean level before the first origin
        filled["__level"] = F.avg(F.when(F.col("step").isNull(), F.col("__y"))).over(whole(keys))
    base = base.withColumns(filled).withColumn("__y", F.col("__y") / F.col("__scale"))
    return base, list(filled)


def _binned(rows: DataFrame, columns: list[str], kept: list[str]) -> DataFrame:
    """Rows with one byte per feature: how many edges (quantiles of the rows before the first origin) lie below its value."""
    levels = [i / BINS for i in range(1, BINS)]
    known = rows.filter(F.col("step").isNull())
    found = known.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), levels, 20_000).alias(c) for c in columns]).first()  # BINS numbers a feature
    edges = [np.unique(np.asarray(found[c] if found[c] is not None else [], dtype=float)) for c in columns]
    wide = rows.select(*kept, F.array(*[F.col(c) for c in columns]).alias("features"))
    schema = wide.drop("features").withColumns({"bins": F.lit(b""), "fits": F.array().cast("array<double>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, values = batch.num_rows, batch.column(len(kept))
            flat = np.asarray(values.flatten().fill_null(np.nan), dtype=float).reshape(n, -1)
            bins = np.column_stack([np.where(np.isfinite(v), np.searchsorted(e, v), BINS) for e, v in zip(edges, flat.T)]).astype(np.uint8) if n else np.empty((0, 1), np.uint8)
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([b.tobytes() for b in bins], pa.binary()), empty], names=[*kept, "bins", "fits"])

    return wide.mapInArrow(run, schema)


def tree_forecasts(
    df: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    date: str = "date",
    kind: str = "rf",
    params: Mapping | None = None,
    grid: Mapping[str, Sequence] | None = None,
    refit: str = "each",
    seed: int = 42,
    folds: int = 3,
    tune_on: str = "newest",
    name: str | None = None,
) -> DataFrame:
    """Random forest (`rf`) or boosted trees (`gbt`). Rows with missing features are kept.

    `refit="each"` grows a model for every origin on all rows before it, all of them in the same passes; `"once"` grows one
    on the rows before the first origin. `grid` is searched once over contiguous folds, again in the same passes; entries
    that these trees don't have raise. Without a row to learn from there are no forecasts.
    """
    if refit not in ("each", "once"):
        raise ValueError(f"refit is 'each' or 'once', not {refit!r}")
    label, keys = name or TREE_MODELS[kind], list(keys)
    plain = TreeSettings.of(kind, params or {})
    candidates = [TreeSettings.of(kind, {**(params or {}), **dict(zip(grid, v))}) for v in product(*grid.values())] if grid else []
    rows, columns = _sized(df, target, features, horizon, keys, date)
    fold = F.lit(None).cast("int")
    if grid:
        member = F.col("__y").isNotNull() & (F.col("__row") < F.col("__rows") if tune_on == "newest" else F.col("step").isNull())
        fold = contiguous_fold(member, folds, keys, date).cast("int")
    uid = F.xxhash64(*keys, "__row")
    rows = rows.withColumns({"fold": fold, "uid": uid}).withColumn("date", F.col(date))
    kept = [*keys, "date", "step", "fold", "uid", "__y", "__scale"]
    # every pass works on all rows for hundreds of trees: spread them, few bytes as they are
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(_binned(rows, columns, kept).repartition(parts, "uid"))
    chosen = _search(rows, candidates, kind, len(columns), seed, folds) if candidates else plain
    origins = [0] if refit == "once" else range(horizon)
    models = fit_models(rows, [Model(o, -1, chosen) for o in origins], kind, len(columns), seed)
    asked = rows.filter(F.col("step").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = _Rows(batch)
            pred = np.full(batch.num_rows, np.nan)
            for step in np.unique(r.step):
                at = np.flatnonzero(r.step == step)
                pred[at] = models[0 if refit == "once" else step].predict(kind, r.bins[at])
            scaled = pa.array(pred * np.asarray(batch.column("__scale")), pa.float64(), from_pandas=True)
            own = [batch.column(c) for c in [*keys, "step", "date"]]
            yield pa.RecordBatch.from_arrays([*own, pa.array([label] * batch.num_rows, pa.string()), scaled], names=[*keys, "step", "date", "model", "pred"])

    schema = asked.select(*keys, "step", "date", F.lit(label).alias("model"), F.col("__y").alias("pred")).schema
    return asked.mapInArrow(run, schema)


def _search(rows: DataFrame, candidates: list[TreeSettings], kind: str, width: int, seed: int, folds: int) -> TreeSettings:
    """The candidate of the lowest mean squared error over the held folds; the first on ties."""
    inside = rows.filter(F.col("fold").isNotNull())
    models = fit_models(inside, [Model(EVERY, f, c) for c in candidates for f in range(folds)], kind, width, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, out = _Rows(batch), []
            for i, m in enumerate(models):
                at = np.flatnonzero((r.fold == m.held) & np.isfinite(r.y))
                if len(at):
                    out.append((i, float(((r.y[at] - m.predict(kind, r.bins[at])) ** 2).sum()), len(at)))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.float64(), pa.int64()))], names=["i", "square", "n"])

    scored = inside.mapInArrow(run, "i int, square double, n long").groupBy("i").agg((F.sum("square") / F.sum("n")).alias("mse"))
    errors = {r["i"]: r["mse"] for r in scored.collect()}  # one number a candidate and fold
    means = [np.mean([errors[i] for i in range(c * folds, (c + 1) * folds) if i in errors] or [np.inf]) for c in range(len(candidates))]
    return candidates[int(np.argmin(np.nan_to_num(means, nan=np.inf)))]
