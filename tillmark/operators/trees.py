"""Forests and boosted trees grown level by level from histograms of calendar features.

The features of a sale are its hour, day, month and weekday, so at most ``CELLS`` combinations (cells) exist,
whatever the number of rows. One pass folds the rows to cells, labels and a count. Sampling is by row all the same: of n equal rows, how many
a tree draws once, twice and so on is a multinomial number, and how many a subsample keeps a binomial one, so
folded rows are drawn with exactly the distribution of single ones. All draws come from generators seeded by cell, label and the part
that the rows belong to, so they do not depend on partitions or retries, and leaving a part (a fold) out changes no other draws.

What a tree sees is then one row per cell: rows drawn, their number and sum of labels. All nodes of a level are
split at once by the histograms of the features' values. Splits do not depend on how deep a tree may grow or how many trees
follow, so the first n trees cut at depth d are the model of (n, d): a search over these grows one set of trees.

Trees are dealt to tasks by block and left-out part, boosted ones by setting; a task holds cells, never rows.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

# Ship the growing functions with the task, so executors do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = ["hour", "day", "month", "weekday_num"]
#: Hours, days of a month, months and weekdays: what bounds every task.
CELLS = 24 * 31 * 12 * 7
#: Trees of a block; all numbers of trees in a search are multiples of it, or the last block is cut.
BLOCK = 10
#: Shares of rows that a bootstrap sample of the same size draws 0, 1, 2 ... times.
_DRAWN = [math.exp(-1) / math.factorial(j) for j in range(12)]


# --- one tree -----------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in levels; ``feature`` is -1 where a node has no children. Values up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    size: np.ndarray
    at_depth: list[np.ndarray] = field(default_factory=list)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node each row of features ends in."""
        node = np.zeros(len(x), np.int64)
        while True:
            going = np.flatnonzero(self.feature[node] >= 0)
            if not len(going):
                return node
            at = node[going]
            node[going] = self.left[at] + (x[going, self.feature[at]] > self.threshold[at])


def grow(
    x: np.ndarray,
    weight: np.ndarray,
    total: np.ndarray,
    rows: np.ndarray,
    *,
    depth: int | None,
    least_split: float = 2,
    least_leaf: float = 1,
    ridge: float = 0.0,
    features: Sequence[int] | None = None,
    cuts: Sequence[int] = (),
) -> Tree:
    """Grow a tree on cells: features ``x`` (whole numbers), weight and sum of the target of each, and the ``rows`` that size limits count.

    A split gains ``l^2 / (wl + ridge) + r^2 / (wr + ridge) - t^2 / (w + ridge)`` for sums l, r and t; of equal gains
    the first feature and the lowest value win. The value of a node is ``t / (w + ridge)``. Cells without weight are
    routed along. ``at_depth`` has the node of each cell in the tree cut at each depth of ``cuts``.
    """
    usable = range(x.shape[1]) if features is None else sorted(features)
    codes, values = zip(*[(np.searchsorted(v, x[:, f]), v) for f in range(x.shape[1]) for v in [np.unique(x[:, f])]])
    node = np.zeros(len(x), np.int64)
    sums = [np.array([a.sum()], float) for a in (weight, total, rows)]
    feature, threshold, left, gains = [], [], [], []
    nodes = [[s[0]] for s in sums]
    first, count, level = 0, 1, 0
    at_depth: dict[int, np.ndarray] = {}
    while count and (depth is None or level < depth):
        if level in cuts:
            at_depth[level] = node.copy()
        active = np.flatnonzero(node >= first)
        place = node[active] - first
        w, t, n = (np.array(s[first:]) for s in nodes)
        best = np.full(count, 1e-12)
        chosen, at, limit = np.full(count, -1), np.zeros(count, np.int64), np.zeros(count)
        for f in usable:
            wide = len(values[f])
            if wide < 2:
                continue
            slot = place * wide + codes[f][active]
            held = [np.bincount(slot, a[active], count * wide).reshape(count, wide) for a in (weight, total, rows)]
            wl, tl, nl = (np.cumsum(h, 1)[:, :-1] for h in held)
            wr, tr, nr = (s[:, None] - part for s, part in zip((w, t, n), (wl, tl, nl)))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = tl * tl / (wl + ridge) + tr * tr / (wr + ridge) - (t * t / (w + ridge))[:, None]
            fit = (nl >= least_leaf) & (nr >= least_leaf) & (wl > 0) & (wr > 0) & (n >= least_split)[:, None]
            gain = np.where(fit, gain, -np.inf)
            top = gain.argmax(1)
            most = gain[np.arange(count), top]
            # Sums in another order differ in the last digits; they do not make a later feature better.
            better = most > best * (1 + 1e-9)
            best[better], chosen[better], at[better] = most[better], f, top[better]
            # The threshold lies halfway to the next value that the node has.
            present = held[2] > 0
            following = np.where(present & (np.arange(wide) > top[:, None]), np.arange(wide), wide - 1).min(1)
            limit[better] = ((values[f][top] + values[f][following]) / 2)[better]
        split = chosen >= 0
        feature.append(chosen)
        threshold.append(limit)
        gains.append(np.where(split, best, 0.0))
        children = first + count + 2 * (np.cumsum(split) - 1)
        left.append(np.where(split, children, -1))
        moving = split[place]
        cells, own = active[moving], place[moving]
        x_of = x[cells, chosen[own]] if len(cells) else np.zeros(0)
        node[cells] = children[own] + (x_of > limit[own])
        first, count = first + count, 2 * int(split.sum())
        fresh = node[cells] - first
        for s, a in zip(nodes, (weight, total, rows)):
            s.extend(np.bincount(fresh, a[cells], count).tolist() if count else [])
        level += 1
    if count:  # the depth limit left a level of leaves
        feature.append(np.full(count, -1))
        threshold.append(np.zeros(count))
        left.append(np.full(count, -1))
        gains.append(np.zeros(count))
    w, t, n = (np.array(s) for s in nodes)
    value = np.where(w + ridge > 0, t / np.where(w + ridge > 0, w + ridge, 1), 0.0)
    tree = Tree(*(np.concatenate(a) for a in (feature, threshold, left)), value, np.concatenate(gains), n)
    tree.at_depth = [at_depth.get(c, node) for c in cuts]
    return tree


# --- cells --------------------------------------------------------------------------------------


def cell_rows(rows: DataFrame, part: str | None) -> DataFrame:
    """Rows folded to ``part, features, label, n``; ``weight`` says how many rows a row stands for."""
    place = F.col(part).cast("int") if part else F.lit(0)
    count = F.sum("weight") if "weight" in rows.columns else F.count(F.lit(1))
    named = rows.where(F.col("label").isNotNull()).withColumn("_part", place)
    folded = named.groupBy("_part", *[F.col(f).cast("int").alias(f) for f in FEATURES], F.col("label").cast("double").alias("label"))
    return folded.agg(F.rint(count).cast("long").alias("n"))


def _ordinal(hour: int, day: int, month: int, weekday: int) -> int:
    return ((hour * 32 + day) * 13 + month) * 7 + weekday


def drawn(folded: DataFrame, trees: int, seed: int, bootstrap: bool, share: float) -> DataFrame:
    """One row per part and cell: ``n, y, yy`` (rows, and sums of the label and its square) and lists with an element per
    tree: ``u, m, s``, rows drawn at least once, draws, and the sum of the label over draws.

    ``bootstrap`` draws as many rows as there are, with replacement; else each row is drawn with probability ``share``.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, done = None, None, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*done))
            types = [pa.int32()] * 5 + [pa.float64()] * 3 + [pa.list_(pa.float64())] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        def closed() -> None:
            done.append((*now, *sums[0].tolist(), *sums[1]))

        for batch in source:  # sorted by cell, part and label
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("_part", *FEATURES)]))
            for key, label, n in zip(keys, batch.column("label").to_pylist(), batch.column("n").to_pylist()):
                if key != now:
                    if now is not None:
                        closed()
                    if len(done) >= 200:
                        yield made()
                        done = []
                    now, sums = key, (np.zeros(3), np.zeros((3, trees)))
                # More trees draw more numbers behind the same first ones.
                generator = np.random.default_rng([seed, key[0] + 1, _ordinal(*key[1:]), int(np.float64(label).view(np.uint64))])
                sums[0][:] += n, n * label, n * label * label
                if bootstrap:
                    times = generator.multinomial(n, [*_DRAWN[:-1], 1 - sum(_DRAWN[:-1])], trees)
                    u, m = n - times[:, 0], times @ np.arange(len(_DRAWN))
                else:
                    u = m = generator.binomial(n, share, trees) if share < 1 else np.full(trees, n)
                sums[1][0] += u
                sums[1][1] += m
                sums[1][2] += m * label
        if now is not None:
            closed()
        if done:
            yield made()

    names = ["_part", *FEATURES, "n", "y", "yy", "u", "m", "s"]
    schema = ", ".join(
        [f"{c} int" for c in names[:5]] + [f"{c} double" for c in names[5:8]] + [f"{c} array<double>" for c in names[8:]]
    )
    dealt = folded.repartition(*FEATURES).sortWithinPartitions(*FEATURES, "_part", "label")
    return dealt.select("_part", *FEATURES, "label", "n").mapInArrow(batches, schema)


@dataclass
class Cells:
    """The cells of a task: features, and sums over the parts that are not left out; ``held`` are the sums of the part that is."""

    x: np.ndarray
    plain: np.ndarray
    held: np.ndarray
    drawn: np.ndarray


def _gathered(rows: list[tuple], left_out: int) -> Cells:
    """``rows``: part, features, n, y, yy and lists u, m, s, sorted by features."""
    parts = np.array([r[0] for r in rows])
    x, cell = np.unique(np.array([r[1:5] for r in rows], np.int64), axis=0, return_inverse=True)
    if len(x) > CELLS:
        raise ValueError(f"more than {CELLS} combinations of calendar features")
    cell = cell.ravel()
    plain, held = np.zeros((len(x), 3)), np.zeros((len(x), 3))
    sums = np.zeros((3, len(x), len(rows[0][8])))
    for i, (c, part) in enumerate(zip(cell, parts)):
        if part == left_out:
            held[c] += rows[i][5:8]
        else:
            plain[c] += rows[i][5:8]
            for k in range(3):
                sums[k, c] += rows[i][8 + k]
    return Cells(x, plain, held, sums)


def _by_key(cells: DataFrame, keys: list[str], made, schema: str) -> DataFrame:
    """``made(key, cells)`` gives the columns of what each group of cells (``keys``, the last one the left-out part) yields."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            columns = made(now, _gathered(held, now[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in source:  # sorted by keys and cell
            columns = [batch.column(c).to_pylist() for c in keys]
            rows = zip(*[batch.column(c).to_pylist() for c in wanted])
            for key, row in zip(zip(*columns), rows):
                if key != now:
                    if held:
                        yield from closed()
                    now, held = key, []
                held.append(row)
        if held:
            yield from closed()

    names = [c.strip().split()[0] for c in schema.split(", ")]
    known = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    lists = {f"array<{k}>": pa.list_(t) for k, t in known.items()}
    types = [(known | lists)[c.strip().split()[1]] for c in schema.split(", ")]
    wanted = ["_part", *FEATURES, "n", "y", "yy", "u", "m", "s"]
    dealt = cells.repartition(*keys).sortWithinPartitions(*keys, *FEATURES, "_part")
    return dealt.select(*keys, *wanted).mapInArrow(batches, schema)


def _left_out(parts: int | None) -> F.Column:
    """The parts left out in turn; -1: none."""
    return F.array(*[F.lit(k) for k in (range(parts) if parts else [-1])])


_NODES = "feature array<int>, threshold array<double>, left array<int>, value array<double>, gain array<double>, size array<double>"


def _columns(trees: list[Tree]) -> list[list]:
    kinds = [np.int32, float, np.int32, float, float, float]
    names = ["feature", "threshold", "left", "value", "gain", "size"]
    return [[getattr(t, name).astype(kind) for t in trees] for name, kind in zip(names, kinds)]


# --- models -------------------------------------------------------------------------------------


class TreeModel:
    """A sum of trees: ``base`` plus ``scale`` times the value of each row's leaf in each tree.

    ``trees`` has a row per tree with its nodes in lists. Rows are predicted by their cell: every distinct
    cell (at most ``CELLS``, which bounds what is broadcast) goes through the trees once, block by block.
    """

    def __init__(self, trees: DataFrame, base: float, scale: float, importance: np.ndarray):
        self.trees, self.base, self.scale = trees, base, scale
        self.featureImportances = DenseVector(importance)

    def transform(self, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        found = durable(rows.select(*[F.col(f).cast("int").alias(f) for f in FEATURES]).distinct()).limit(CELLS + 1).collect()
        if len(found) > CELLS:
            raise ValueError(f"more than {CELLS} combinations of calendar features")
        cells = np.array(sorted(tuple(r) for r in found), np.int64).reshape(-1, len(FEATURES))
        known = spark.sparkContext.broadcast(cells)

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, sums = known.value, np.zeros(len(known.value))
            for batch in source:
                columns = [[np.array(v) for v in batch.column(c).to_pylist()] for c in names]
                for nodes in zip(*columns):
                    tree = Tree(*nodes)
                    sums += tree.value[tree.leaf(x)]
            arrays = [pa.array(x[:, i].astype(np.int32)) for i in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sums)], names=[*FEATURES, "sums"])

        names = ["feature", "threshold", "left", "value", "gain", "size"]
        schema = ", ".join(f"{f} int" for f in FEATURES) + ", sums double"
        values = self.trees.orderBy("tree").select(*names).mapInArrow(batches, schema)
        values = values.groupBy(*FEATURES).agg((F.lit(self.base) + F.lit(self.scale) * F.sum("sums")).alias("prediction"))
        return rows.join(F.broadcast(values), FEATURES, "left")


def _scores(values: DataFrame, held: DataFrame, names: list[str]) -> DataFrame:
    """``names, left_out, r2`` from ``names, left_out, features, prediction`` and what the left-out cells hold."""
    p = F.col("prediction")
    sums = values.join(held, ["left_out", *FEATURES]).groupBy("left_out", *names).agg(
        F.sum(F.col("yy") - 2 * p * F.col("y") + p * p * F.col("n")).alias("sse"),
        F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("yy").alias("yy"),
    )
    variation = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    flat = F.when(F.col("sse") <= 0, 1.0).otherwise(0.0)
    return sums.select(*names, "left_out", F.when(variation > 0, 1 - F.col("sse") / variation).otherwise(flat).alias("r2"))


def _held(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("_part").alias("left_out"), *FEATURES, "n", "y", "yy")


class _Estimator:
    defaults: dict = {}

    def __init__(self, seed: int = 42, **params):
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise TypeError(f"unknown parameters: {sorted(unknown)}")
        self.seed, self.params = seed, {**self.defaults, **params}

    def with_params(self, **params) -> _Estimator:
        return type(self)(self.seed, **{**self.params, **params})

    def fold_scores(self, rows: DataFrame, part: str, parts: int, grid: dict[str, Sequence] | None = None) -> DataFrame:
        """A column for each parameter of the grid, ``left_out`` and ``r2`` there of the model fitted without that part."""
        return self._fold_scores(rows, part, parts, {k: list(v) for k, v in (grid or {}).items()})


class HistogramForest(_Estimator):
    """Averages trees grown on bootstrap samples; every split looks at all features.

    ``maxDepth`` None has no limit. ``minSplit`` and ``minLeaf`` count different rows of the sample.
    """

    defaults = {"numTrees": 150, "maxDepth": 8, "minSplit": 2, "minLeaf": 1, "bootstrap": True}

    def fit(self, rows: DataFrame, part: str | None = None) -> TreeModel:
        p = self.params
        cells = drawn(cell_rows(rows, part), p["numTrees"], self.seed, p["bootstrap"], 1.0)

        def made(key: tuple, own: Cells) -> list:
            trees = [
                grow(own.x, own.drawn[1][:, t], own.drawn[2][:, t], own.drawn[0][:, t], depth=p["maxDepth"],
                     least_split=p["minSplit"], least_leaf=p["minLeaf"])
                for t in range(own.drawn.shape[2])
            ]
            return [[key[0] * BLOCK + i for i in range(len(trees))], *_columns(trees)]

        trees = durable(_by_key(self._blocks(cells, None), ["block", "left_out"], made, f"tree int, {_NODES}"))
        # Each tree's gains by feature sum to one; trees without a split do not count.
        gains = trees.select("tree", F.explode(F.arrays_zip("feature", "gain")).alias("g")).where("g.feature >= 0")
        share = gains.groupBy("tree", F.col("g.feature").alias("feature")).agg(F.sum("g.gain").alias("gain"))
        whole = share.groupBy("tree").agg(F.sum("gain").alias("whole"))
        share = share.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
        return TreeModel(trees, 0.0, 1 / p["numTrees"], _shares(share))

    @staticmethod
    def _blocks(cells: DataFrame, parts: int | None) -> DataFrame:
        """Cells repeated for each block of trees and left-out part, with the block's draws."""
        blocks = F.sequence(F.lit(0), F.floor((F.size("m") - 1) / BLOCK).cast("int"))
        dealt = cells.withColumn("block", F.explode(blocks)).withColumn("left_out", F.explode(_left_out(parts)))
        own = {c: F.slice(c, F.col("block") * BLOCK + 1, F.lit(BLOCK)) for c in ("u", "m", "s")}
        return dealt.withColumns(own)

    def _fold_scores(self, rows: DataFrame, part: str, parts: int, grid: dict) -> DataFrame:
        names = list(grid)
        wanted = {k: grid.get(k, [self.params[k]]) for k in self.defaults}
        cells = durable(drawn(cell_rows(rows, part), max(wanted["numTrees"]), self.seed, self.params["bootstrap"], 1.0))
        depths, counts = wanted["maxDepth"], wanted["numTrees"]
        deepest = None if None in depths else max(depths)
        # Where the depth is the largest one, the whole tree is meant.
        cuts = [d if d is not None else -1 for d in depths]
        settings = list(itertools.product(wanted["minSplit"], wanted["minLeaf"]))

        def made(key: tuple, own: Cells) -> list:
            block, left_out = key
            seen = np.flatnonzero(own.held[:, 0] > 0)
            sums = np.zeros((len(counts), len(settings), len(depths), len(seen)))
            for t in range(own.drawn.shape[2]):
                u, m, s = own.drawn[:, :, t]
                for i, (split, leaf) in enumerate(settings):
                    tree = grow(own.x, m, s, u, depth=deepest, least_split=split, least_leaf=leaf, cuts=cuts)
                    for j, node in enumerate(tree.at_depth):
                        for c, count in enumerate(counts):
                            if block * BLOCK + t < count:
                                sums[c, i, j] += tree.value[node[seen]]
            features = [own.x[seen, f].astype(np.int32) for f in range(own.x.shape[1])]
            return [np.full(len(seen), left_out, np.int32), *features, list(sums.reshape(-1, len(seen)).T.copy())]

        schema = "left_out int, " + ", ".join(f"{f} int" for f in FEATURES) + ", sums array<double>"
        found = _by_key(self._blocks(cells, parts), ["block", "left_out"], made, schema)
        points = [
            {"numTrees": n, "minSplit": split, "minLeaf": leaf, "maxDepth": d}
            for n in counts for split, leaf in settings for d in depths
        ]
        each = found.select("left_out", *FEATURES, F.posexplode("sums").alias("point", "sums"))
        each = each.groupBy("point", "left_out", *FEATURES).agg(F.sum("sums").alias("sums"))
        scale = F.element_at(F.array(*[F.lit(1.0 / p["numTrees"]) for p in points]), F.col("point") + 1)
        scores = _scores(each.withColumn("prediction", F.col("sums") * scale), _held(cells), ["point"])
        return _named(scores, points, names)


class BoostedHistograms(_Estimator):
    """Second-order boosting of squared errors: each tree is grown on what the ones before it leave, from a share of the
    rows and of the features, with a ridge on its values."""

    defaults = {"maxIter": 100, "stepSize": 0.05, "maxDepth": 5, "rowShare": 0.8, "featureShare": 0.8, "ridge": 1.0, "minWeight": 1.0}

    def _chain(self, own: Cells, params: dict):
        """Trees one after the other, and the predictions for all cells after each."""
        rows, label = own.plain[:, 0].sum(), own.plain[:, 1].sum()
        base = label / rows if rows else 0.0
        now = np.full(len(own.x), base)
        k = max(1, int(params["featureShare"] * own.x.shape[1]))
        for t in range(params["maxIter"]):
            features = np.random.default_rng([self.seed, 7, t]).permutation(own.x.shape[1])[:k]
            m, s = own.drawn[1][:, t], own.drawn[2][:, t]
            tree = grow(own.x, m, s - m * now, m, depth=params["maxDepth"], least_split=0, least_leaf=params["minWeight"],
                        ridge=params["ridge"], features=features, cuts=[params["maxDepth"]])
            now = now + params["stepSize"] * tree.value[tree.at_depth[0]]
            yield base, tree, now

    def fit(self, rows: DataFrame, part: str | None = None) -> TreeModel:
        p = self.params
        cells = drawn(cell_rows(rows, part), p["maxIter"], self.seed, False, p["rowShare"])

        def made(key: tuple, own: Cells) -> list:
            bases, trees, _ = zip(*self._chain(own, p))
            return [list(range(len(trees))), list(bases), *_columns(list(trees))]

        one = cells.withColumns({"setting": F.lit(0), "left_out": F.lit(-1)})
        trees = durable(_by_key(one, ["setting", "left_out"], made, f"tree int, base double, {_NODES}"))
        first = trees.agg(F.max("base")).first()[0]
        gains = trees.select(F.explode(F.arrays_zip("feature", "gain")).alias("g")).where("g.feature >= 0")
        share = gains.groupBy(F.col("g.feature").alias("feature")).agg(F.avg("g.gain").alias("share"))
        return TreeModel(trees.drop("base"), first or 0.0, p["stepSize"], _shares(share))

    def _fold_scores(self, rows: DataFrame, part: str, parts: int, grid: dict) -> DataFrame:
        names, counts = list(grid), grid.get("maxIter", [self.params["maxIter"]])
        if "rowShare" in grid:
            raise ValueError("the share of rows is not part of a grid")
        others = {k: v for k, v in grid.items() if k != "maxIter"}
        chains = [{**self.params, **dict(zip(others, values)), "maxIter": max(counts)} for values in itertools.product(*others.values())]
        cells = durable(drawn(cell_rows(rows, part), max(counts), self.seed, False, self.params["rowShare"]))

        def made(key: tuple, own: Cells) -> list:
            chain, left_out = key
            seen = np.flatnonzero(own.held[:, 0] > 0)
            after = {t + 1: now[seen] for t, (_, _, now) in enumerate(self._chain(own, chains[chain])) if t + 1 in counts}
            columns = [[], *[[] for _ in FEATURES], [], []]
            for c, count in enumerate(counts):
                values = [np.full(len(seen), left_out, np.int32), *[own.x[seen, f].astype(np.int32) for f in range(own.x.shape[1])]]
                values += [np.full(len(seen), c * len(chains) + chain, np.int32), after[count]]
                columns = [np.concatenate([a, v]) if len(a) else v for a, v in zip(columns, values)]
            return columns

        dealt = cells.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(chains) - 1))))
        dealt = dealt.withColumn("left_out", F.explode(_left_out(parts)))
        schema = "left_out int, " + ", ".join(f"{f} int" for f in FEATURES) + ", point int, prediction double"
        found = _by_key(dealt, ["setting", "left_out"], made, schema)
        points = [{**chain, "maxIter": count} for count in counts for chain in chains]
        return _named(_scores(found, _held(cells), ["point"]), points, names)


def _shares(gains: DataFrame) -> np.ndarray:
    """``feature, share`` (a row per feature) as shares of one."""
    values = np.zeros(len(FEATURES))
    for row in gains.collect():
        values[row["feature"]] = row["share"]
    return values / values.sum() if values.sum() > 0 else values


def _named(scores: DataFrame, points: list[dict], names: list[str]) -> DataFrame:
    """Points by their parameters."""
    def column(name: str) -> F.Column:
        values = [F.lit(None).cast("double") if p[name] is None else F.lit(float(p[name])) for p in points]
        return F.element_at(F.array(*values), F.col("point") + 1).alias(name)

    return scores.select(*[column(n) for n in names], "left_out", "r2")
