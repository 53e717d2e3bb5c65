"""Gradient boosting with one softmax over all classes, as Spark passes over a binned matrix.

The matrix is kept as blocks of arrays, the one place of the library that is not a DataFrame:
boosting is thousands of short passes of array sums over the same partitions, and planning a
query for each takes longer than the pass.

Every feature is cut into at most ``bins`` bins by quantiles; a row is then one byte per
feature.  A round grows one tree per class, level by level: each level is one pass in which
every task adds up the gradients of its rows by (tree, node, feature, bin), and one aggregate
over the tasks.  Gradients are counted in whole units of 2^-24, so sums and with them trees do
not depend on how the rows are partitioned.  What reaches the driver are those sums, bounded
by classes x nodes x features x bins and not by rows; it picks the splits.

A matrix that is small enough for one task anyway (fewer than two shares of ``TASK_ROWS`` rows
and models) has nothing to send: that task runs all rounds by the same code, instead of a job
for every level.

Several models train side by side over the same matrix: model ``j`` learns from the rows whose
``fold`` is not ``j`` and is judged on those whose ``fold`` is ``j``.  So cross-validation costs
the passes of one model.  A model whose loss on its judged rows has not fallen for
``patience`` rounds stops and keeps its best rounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import first_argmax

# The published model's depth, rounds, rate, sampling, regularisation and seed.
PARAMS = {
    "depth": 4, "rounds": 800, "rate": 0.05, "rows": 0.8, "columns": 0.6, "seed": 42,
    "child_weight": 6.0, "l1": 0.15, "l2": 1.5, "patience": 50, "bins": 64,
}
UNIT = float(1 << 24)
# Rounds whose trees are walked anew in every pass before margins are written down.
PENDING = 4
# Rows times models that a task of the matrix should have at most, and at least.
TASK_ROWS = 50_000
LEAST_ROWS = 10_000
# Up to so many tasks send their sums straight to the driver.
FEW_TASKS = 32


@dataclass
class Trees:
    """Trees of one depth as heaps: ``[round, class, node]``.

    A row at a node goes right if its bin of ``feature`` is above ``cut``.  Nodes that do not
    split send all rows left, to the leaf that has their value.
    """

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int, classes: int) -> Trees:
        shape = (0, classes, (1 << depth) - 1)
        leaves = (0, classes, 1 << depth)
        return Trees(depth, np.zeros(shape, np.int32), np.full(shape, 255, np.uint8),
                     np.zeros(leaves), np.zeros(shape))

    def add(self, feature, cut, value, gain) -> None:
        self.feature = np.concatenate([self.feature, feature[None]])
        self.cut = np.concatenate([self.cut, cut[None]])
        self.value = np.concatenate([self.value, value[None]])
        self.gain = np.concatenate([self.gain, gain[None]])

    def part(self, start: int, end: int | None = None) -> Trees:
        s = slice(start, end)
        return Trees(self.depth, self.feature[s], self.cut[s], self.value[s], self.gain[s])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values ``[row, class]`` of binned rows."""
        return self.added(np.zeros((len(x), self.feature.shape[1])), x)

    def added(self, total: np.ndarray, x: np.ndarray) -> np.ndarray:
        """``total`` with the leaf values of binned rows, added tree by tree."""
        rounds, classes, _ = self.feature.shape
        for r in range(rounds):
            for k in range(classes):
                at = places(x, self.feature[r, k], self.cut[r, k], self.depth)
                total[:, k] += self.value[r, k, at]
        return total


def places(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row among those of its level, after ``levels`` levels of a heap."""
    rows = np.arange(len(x))
    at = np.zeros(len(x), np.int64)
    for level in range(levels):
        node = at + (1 << level) - 1
        at = 2 * at + (x[rows, feature[node]] > cut[node])
    return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def drawn(hashes: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Which rows a round learns from: a hash of the row and the round."""
    mixed = (int(seed) << 20) ^ (round_ * 0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = hashes.astype(np.uint64) ^ np.uint64(mixed & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


def gradients(p: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives ``[row, class]`` of the loss in whole units."""
    g = p.copy()
    g[np.arange(len(p)), label] -= 1.0
    h = np.maximum(2.0 * p * (1.0 - p), 1e-6)
    return np.rint(g * UNIT), np.rint(h * UNIT)


@dataclass
class Splits:
    """Chosen splits of one level, ``[tree, node]``; ``feature`` is -1 without one."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    right: np.ndarray


def leaf_value(g, h, p: Mapping[str, float]) -> np.ndarray:
    shrunk = np.sign(g) * np.maximum(np.abs(g) - p["l1"], 0.0)
    return -p["rate"] * shrunk / (h + p["l2"])


def best_splits(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, p: Mapping[str, float]) -> Splits:
    """The best split of every node from sums ``[tree, node, feature, bin]`` in units.

    ``allowed[tree, feature]`` says which features a tree may use.  Ties go to the first
    feature, then to the lowest bin.
    """
    def strength(a, b):
        shrunk = np.maximum(np.abs(a) - p["l1"], 0.0)
        return shrunk * shrunk / (b + p["l2"])

    gl, hl = np.cumsum(g, axis=3) / UNIT, np.cumsum(h, axis=3) / UNIT
    gt, ht = gl[..., -1:], hl[..., -1:]
    gr, hr = gt - gl, ht - hl
    gain = 0.5 * (strength(gl, hl) + strength(gr, hr) - strength(gt, ht))
    fine = (hl >= p["child_weight"]) & (hr >= p["child_weight"]) & allowed[:, None, :, None]
    # gains are compared in steps that rounding errors do not reach
    gain = np.where(fine & (gain > 1e-6), np.round(gain, 9), -np.inf)
    trees, nodes, _, bins = gain.shape
    flat = gain.reshape(trees, nodes, -1)
    at = flat.argmax(axis=2)
    best = np.take_along_axis(flat, at[..., None], 2)[..., 0]
    feature, cut = at // bins, at % bins

    def of(a):
        return np.take_along_axis(a.reshape(trees, nodes, -1), at[..., None], 2)[..., 0]

    found = np.isfinite(best)
    return Splits(np.where(found, feature, -1), cut, np.where(found, best, 0.0),
                  np.stack([of(gl), of(hl)], -1), np.stack([of(gr), of(hr)], -1))


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending cut points of every feature, at most ``bins - 1``."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[
        F.percentile_approx(F.col(f"`{c}`").cast("double"), probs, 20 * bins).alias(f"q{i}")
        for i, c in enumerate(features)
    ]).first()
    return [np.unique(np.array(q or [], np.float64)) for q in row]


def to_bins(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bytes ``[row, feature]``: how many cuts lie below a value; missing values count as least."""
    out = np.empty(values.shape, np.uint8)
    for i, c in enumerate(cuts):
        column = values[:, i]
        out[:, i] = np.where(np.isnan(column), 0, np.searchsorted(c, column, "left"))
    return out


# A block of rows: hashes, classes, folds, bins [row, feature], margins [row, model, class].
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def binned(
    df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], label: str,
    fold: str | None, key: str | None, models: int, classes: int,
) -> RDD:
    """The rows as blocks of arrays, one per Arrow batch, with all margins 0."""
    same = [F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    source = df.select(
        F.xxhash64(key if key else F.struct(*same, F.col(label))).alias("h"),
        F.col(label).cast("int").alias("label"),
        (F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)).alias("fold"),
        *same,
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([
                c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[3:]])
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows.append(to_bins(values, cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes()], pa.binary()) for r in rows], names=["h", "y", "f", "x"])

    def block(row) -> Block:
        h, y, f = (np.frombuffer(b, k) for b, k in zip(row, (np.int64, np.int32, np.int32)))
        x = np.frombuffer(row[3], np.uint8).reshape(len(h), len(features))
        return h, y, f, x, np.zeros((len(h), models, classes))

    return source.mapInArrow(packed, "h binary, y binary, f binary, x binary").rdd.map(block)


def _joined(blocks: Iterable[Block]) -> Iterator[Block]:
    """The blocks of a task as one; array sums over many short ones are mostly calls."""
    blocks = list(blocks)
    if blocks:
        yield tuple(map(np.concatenate, zip(*blocks, strict=True)))


def _margins_of(block: Block, pending: Sequence[Trees]) -> np.ndarray:
    """The block's margins with those of the trees that are not written yet."""
    m = block[4].copy()
    for j, trees in enumerate(pending):
        trees.added(m[:, j], block[3])
    return m


def _task_sums(
    blocks: Iterable[Block], n_features: int, pending: Sequence[Trees], active: Sequence[int],
    grown: np.ndarray, cuts: np.ndarray, allowed: np.ndarray, level: int, round_: int,
    p: Mapping[str, float], classes: int,
) -> np.ndarray:
    """Gradient sums of one level over the blocks of a task, then the models' losses, as one array."""
    bins, nodes = int(p["bins"]), 1 << level
    per_tree, trees = nodes * n_features * bins, len(active) * classes
    sums = np.zeros((2, trees * per_tree + len(active)))
    for block in blocks:
        hashes, label, fold, x, _ = block
        m = _margins_of(block, pending)
        taken = drawn(hashes, round_, int(p["seed"]), p["rows"])
        for a, j in enumerate(active):
            chance = softmax(m[:, j])
            if level == 0:
                judged = fold == j
                own = np.log(np.maximum(chance[judged, label[judged]], 1e-15))
                sums[:, trees * per_tree + a] += -np.rint(own * UNIT).sum(), judged.sum()
            mine = taken & (fold != j)
            xs = x[mine]
            g, h = gradients(chance[mine], label[mine])
            for k in range(classes):
                tree = a * classes + k
                at = places(xs, grown[tree], cuts[tree], level)
                columns = np.flatnonzero(allowed[tree])
                slot = ((at[:, None] * n_features + columns) * bins + xs[:, columns]).ravel()
                part = slice(tree * per_tree, (tree + 1) * per_tree)
                for total, weight in ((sums[0], g[:, k]), (sums[1], h[:, k])):
                    total[part] += np.bincount(
                        slot, np.repeat(weight, len(columns)), per_tree)
    return sums


class _Passes:
    """The matrix as partitions: a level is a job, and margins are written down now and then."""

    def __init__(self, matrix: RDD, n_features: int):
        self.matrix, self.n_features, self.written = matrix, n_features, 0

    def sums(self, trees: Sequence[Trees], *level) -> np.ndarray:
        """What the tasks add up; with many tasks it is added up on the way."""
        pending, n_features = [t.part(self.written) for t in trees], self.n_features

        def task(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
            yield _task_sums(blocks, n_features, pending, *level)

        sent = self.matrix.mapPartitions(task)
        few = sent.getNumPartitions() <= FEW_TASKS
        return sent.reduce(np.add) if few else sent.treeReduce(np.add)

    def begin(self, trees: Sequence[Trees], round_: int) -> None:
        if round_ - self.written >= PENDING:
            before, pending = self.matrix, [t.part(self.written) for t in trees]
            self.matrix = before.map(
                lambda block: (*block[:4], _margins_of(block, pending))
            ).persist(StorageLevel.MEMORY_AND_DISK)
            self.matrix.count()
            before.unpersist()
            self.written = round_


class _OneTask:
    """The blocks of a matrix that one task holds, with all margins up to date."""

    def __init__(self, blocks: Iterable[Block], n_features: int):
        self.blocks, self.n_features, self.written = list(_joined(blocks)), n_features, 0

    def sums(self, trees: Sequence[Trees], *level) -> np.ndarray:
        return _task_sums(self.blocks, self.n_features, [], *level)

    def begin(self, trees: Sequence[Trees], round_: int) -> None:
        pending = [t.part(self.written) for t in trees]
        self.blocks = [(*block[:4], _margins_of(block, pending)) for block in self.blocks]
        self.written = round_


def _grow(
    over: _Passes | _OneTask, grown_so_far: Sequence[Trees], active: Sequence[int], round_: int,
    p: Mapping[str, float], classes: int,
) -> tuple[list[tuple], dict[int, tuple[float, int]]]:
    """One tree per class of every active model, and the models' losses before it."""
    depth, trees, n_features = int(p["depth"]), len(active) * classes, over.n_features
    feature = np.zeros((trees, (1 << depth) - 1), np.int32)
    cut = np.full((trees, (1 << depth) - 1), 255, np.uint8)
    gains = np.zeros((trees, (1 << depth) - 1))
    value = np.zeros((trees, 1 << depth))
    allowed = np.zeros((trees, n_features), bool)
    chosen = max(1, round(p["columns"] * n_features))
    for a, j in enumerate(active):
        for k in range(classes):
            rng = np.random.default_rng([int(p["seed"]), round_, j, k])
            allowed[a * classes + k, rng.choice(n_features, chosen, replace=False)] = True
    open_ = np.ones((trees, 1), bool)  # nodes of the level that may split
    losses: dict[int, tuple[float, int]] = {}
    for level in range(depth):
        total = over.sums(
            grown_so_far, active, feature, cut, allowed, level, round_, p, classes)
        size = trees * n_features * int(p["bins"]) << level
        g, h = total[:, :size].reshape(2, trees, 1 << level, n_features, int(p["bins"]))
        if level == 0:
            losses = {j: (a / UNIT, int(n)) for j, a, n in zip(active, *total[:, size:]) if n}
            first = allowed.argmax(axis=1)
            root = [s[np.arange(trees), 0, first].sum(axis=1) / UNIT for s in (g, h)]
            value[:, 0] = leaf_value(root[0], root[1], p)
        found = best_splits(g, h, allowed, p)
        splits = (found.feature >= 0) & open_
        base, wide = (1 << level) - 1, 1 << (depth - level)
        opened = np.zeros((trees, 2 << level), bool)
        for tree, node in zip(*np.nonzero(splits), strict=True):
            feature[tree, base + node] = found.feature[tree, node]
            cut[tree, base + node] = found.cut[tree, node]
            gains[tree, base + node] = found.gain[tree, node]
            value[tree, node * wide] = leaf_value(*found.left[tree, node], p)
            value[tree, node * wide + wide // 2] = leaf_value(*found.right[tree, node], p)
            opened[tree, 2 * node : 2 * node + 2] = True
        open_ = opened
        if not splits.any():
            break
    grown = [
        tuple(a[i * classes : (i + 1) * classes] for a in (feature, cut, value, gains))
        for i in range(len(active))
    ]
    return grown, losses


def _all_rounds(
    over: _Passes | _OneTask, models: int, classes: int, p: Mapping[str, float]
) -> list[tuple[Trees, list[float]]]:
    """The trees of every model, and its losses before each of them."""
    trees = [Trees.empty(int(p["depth"]), classes) for _ in range(models)]
    losses: list[list[float]] = [[] for _ in range(models)]
    active = list(range(models))
    for round_ in range(int(p["rounds"]) + 1):
        over.begin(trees, round_)
        last = round_ == int(p["rounds"])
        if last and not any(losses):
            break
        grown, judged = _grow(
            over, trees, active, round_, {**p, "depth": 1} if last else p, classes)
        still = []
        for a, j in enumerate(active):
            if j in judged:
                losses[j].append(judged[j][0] / judged[j][1])
            if losses[j] and len(losses[j]) - 1 - int(np.argmin(losses[j])) >= p["patience"]:
                continue
            if not last:
                trees[j].add(*grown[a])
            still.append(j)
        active = still
        if last or not active:
            break
    return list(zip(trees, losses, strict=True))


@dataclass
class BoostedModel:
    """A fitted model: cut points and trees, and how it was judged while it grew."""

    features: list[str]
    cuts: list[np.ndarray]
    trees: Trees
    losses: list[float] = field(default_factory=list)

    @property
    def importances(self) -> np.ndarray:
        """Share of every feature in the total gain of all splits."""
        total = np.bincount(self.trees.feature.ravel(), self.trees.gain.ravel(), len(self.features))
        return total / total.sum() if total.sum() else np.full(len(self.features), 1 / len(total))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (an array) and ``prediction``, the first greatest."""
        cuts, trees = self.cuts, self.trees

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def probabilities(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            rows = np.array(values.tolist(), np.float64)
            return pd.Series(list(softmax(trees.margins(to_bins(rows, cuts)))))

        given = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features])
        return df.withColumn("probability", probabilities(given)).withColumn(
            "prediction", first_argmax(F.col("probability")).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as one table: a row of names and cuts, and a row per round and class."""
        t = self.trees
        rows = [(-1, 0, json.dumps({"features": self.features, "depth": t.depth,
                                    "classes": t.feature.shape[1], "losses": self.losses,
                                    "cuts": [c.tolist() for c in self.cuts]}))]
        rows += [
            (r, k, json.dumps({n: getattr(t, n)[r, k].tolist()
                               for n in ("feature", "cut", "value", "gain")}))
            for r in range(len(t.feature)) for k in range(t.feature.shape[1])
        ]
        table = spark.createDataFrame(rows, "round int, class int, content string")
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        rows = spark.read.parquet(path).orderBy("round", "class").collect()
        head = json.loads(rows[0]["content"])
        classes = head["classes"]
        trees = Trees.empty(head["depth"], classes)
        for at in range(1, len(rows), classes):
            tree = [json.loads(r["content"]) for r in rows[at : at + classes]]
            trees.add(*(np.array([t[n] for t in tree], kind) for n, kind in (
                ("feature", np.int32), ("cut", np.uint8), ("value", float), ("gain", float))))
        return BoostedModel(head["features"], [np.array(c, float) for c in head["cuts"]], trees,
                            head["losses"])


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str = "label", fold: str | None = None,
    models: int = 1, classes: int = 3, key: str | None = None,
    params: Mapping[str, float] | None = None,
) -> list[BoostedModel]:
    """``models`` boosted models side by side, model ``j`` learning from ``fold <> j``.

    Without ``fold`` every row is learnt from and no loss is judged.  ``key`` names rows for
    the sampling; without it equal rows are drawn together.  Rows with a NULL label are left out,
    and a NULL fold is none of the models' own.
    """
    p = {**PARAMS, **(params or {})}
    names = list(features)
    if not names:
        raise ValueError("no features")
    df = df.filter(F.col(label).isNotNull())
    cuts = quantile_cuts(df, names, int(p["bins"]))
    weight = df.count() * models
    tasks, n_features = max(1, weight // TASK_ROWS), len(names)
    if tasks == 1:
        matrix = binned(df, names, cuts, label, fold, key, models, classes).coalesce(1)
        fitted = matrix.mapPartitions(
            lambda blocks: [_all_rounds(_OneTask(blocks, n_features), models, classes, p)]).first()
    else:
        # all cores, unless their shares of the rows get too small
        tasks = max(tasks, min(df.sparkSession.sparkContext.defaultParallelism,
                               weight // LEAST_ROWS))
        matrix = binned(df.repartition(tasks), names, cuts, label, fold, key, models, classes)
        matrix = matrix.mapPartitions(_joined).persist(StorageLevel.MEMORY_AND_DISK)
        over = _Passes(matrix, n_features)
        fitted = _all_rounds(over, models, classes, p)
        over.matrix.unpersist()
    # the loss after n trees is the n-th, so the best is also how many rounds are kept
    return [
        BoostedModel(names, cuts, t.part(0, int(np.argmin(loss)) if loss else None), loss)
        for t, loss in fitted
    ]
