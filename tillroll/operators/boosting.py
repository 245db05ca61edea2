"""Boosted trees for a label of 0 or 1, fitted on values in bins, with one pass over the rows per level.

The method is that of `GBTClassifier`, and the result is its model: logistic loss of labels -1 and 1, a first tree
on the labels and later ones on the gradients, splits by variance between at most 32 bins per column, and a stop
at the first tree that the held-out rows gain too little from. Other than there, each value is one byte, a task
counts whole blocks of rows and two columns at a time, only the smaller child of a node is counted, and the step to
the next tree, the held-out loss and the first level share a pass. Bins come from all rows, not from a sample.

Only counts per node, column and bin leave a task, and where these are many they are added up by tasks before they
reach the driver, so neither grows with the rows.
"""

from __future__ import annotations

import functools
import math
import pickle
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.workers import deploy

MAX_BINS = 32
# a column with more different values is summed up by so many, evenly over its rows
MOST_VALUES = 8192
BLOCK = 131_072
# rows that one task takes before there are more tasks than the cluster can run at once
ALONE = 4 * BLOCK
# rows that are worth a task of their own
TASK_ROWS = 16_384
# after so many trees the scores are worked out from the start, so that no row depends on a long chain of jobs
CHAIN = 20
# the counts of so many nodes (about 20 kB each) are added up by the driver, which saves a shuffle; more by tasks
MOST_COLLECTED = 1024
# an impurity below is none
TINY = 2.3e-16
# what sums over many rows may be off by, of their size
ROUNDING = 1e-12
# what a pass before a tree tells besides the counts of nodes
LOSS, SQUARES = 0, -1

Counts = dict[int, np.ndarray]


@dataclass(frozen=True)
class Settings:
    depth: int
    least: int  # rows of a node
    share: float  # of the rows, for each tree
    columns: float  # of the columns, for each node
    seed: int


@dataclass
class Tree:
    """Nodes in heap order, the root being 1: a row goes left where its bin is at most `cut`."""

    column: np.ndarray  # -1 where there is no split
    cut: np.ndarray
    gain: np.ndarray
    sums: np.ndarray  # rows, sum and sum of squares of what is fitted

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1)
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros((n, 3)))

    def down(self, pairs: np.ndarray, rows: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row some levels below `at`, or the leaf above it."""
        flat, node, split = pairs.ravel(), np.arange(len(self.column)), self.column >= 0
        column = np.where(split, self.column, 0)
        start, shift = column // 2 * pairs.shape[1], np.where(column % 2, 0, 5).astype(np.uint16)
        left, cut = np.where(split, 2 * node, node), np.where(split, self.cut, MAX_BINS).astype(np.uint16)
        for _ in range(levels):
            bins = (flat.take(start.take(at) + rows) >> shift.take(at)) & (MAX_BINS - 1)
            at = left.take(at) + (bins > cut.take(at))
        return at

    def values(self) -> np.ndarray:
        return self.sums[:, 1] / np.maximum(self.sums[:, 0], 1)

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        n = pairs.shape[1]
        return self.down(pairs, np.arange(n), np.ones(n, np.int64), int(math.log2(len(self.column))) - 1)


@dataclass
class Block:
    """Rows of one task; those that are fitted come first. `score` is the weighted sum of the trees so far."""

    number: int
    pairs: np.ndarray  # the bins of columns 2i and 2i + 1 as one number, by i and row
    label: np.ndarray  # -1 or 1
    fitted: int
    score: np.ndarray
    squares: np.ndarray | None = None  # per node of the last tree, of what it was fitted to
    placed: tuple | None = None  # the drawn rows, their nodes and the level of these

    def moved(self, trees: Sequence[Tree], weights: Sequence[float], how: Settings) -> Block:
        """With the scores after these trees, the last of which has the number `len(weights) - 1` of all."""
        out = Block(self.number, self.pairs, self.label, self.fitted, self.score.copy())
        for i, (tree, weight) in enumerate(zip(trees, weights[len(weights) - len(trees) :])):
            at = tree.places(self.pairs)
            if i + 1 == len(trees):
                n = len(weights) - 1
                rows = out.drawn(n, how)
                out.squares = np.bincount(at[rows], out.wanted(n == 0, rows) ** 2, len(tree.column))
            out.score += weight * tree.values().take(at)
        return out

    def drawn(self, n: int, how: Settings) -> np.ndarray:
        """The rows that a tree is fitted to."""
        return np.flatnonzero(np.random.default_rng((how.seed, n, self.number)).random(self.fitted) < how.share)

    def nodes(self, tree: Tree, level: int, n: int, how: Settings) -> tuple[np.ndarray, np.ndarray]:
        """The drawn rows and their nodes at a level, from where the level before left them, if it was here."""
        rows = self.drawn(n, how) if level == 0 or self.placed is None else self.placed[0]
        at, upto = (np.ones(len(rows), np.int64), 0) if level == 0 or self.placed is None else self.placed[1:]
        at = tree.down(self.pairs, rows, at, level - upto)
        self.placed = rows, at, level
        return rows, at

    def wanted(self, first: bool, rows: np.ndarray) -> np.ndarray:
        """What a tree is fitted to: the labels, or the gradients of the loss 2 log(1 + exp(-2 y s))."""
        y = self.label.take(rows).astype(float)
        return y if first else 4.0 * y / (1.0 + np.exp(2.0 * y * self.score.take(rows)))

    def held_out_loss(self) -> np.ndarray:
        y, s = self.label[self.fitted :], self.score[self.fitted :]
        return np.array([2.0 * np.logaddexp(0.0, -2.0 * y * s).sum(), float(len(y))])

    def ended(self) -> dict[int, np.ndarray]:
        """The held-out loss, and the squares of the last tree."""
        return {LOSS: self.held_out_loss()} | ({} if self.squares is None else {SQUARES: self.squares})


# values and bins -------------------------------------------------------------------------------

Counted = list[tuple[np.ndarray, np.ndarray]]


def _thinned(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most MOST_VALUES of the values, each with the rows of those left out just below it."""
    if len(values) <= MOST_VALUES:
        return values, counts
    upto = np.cumsum(counts)
    group = np.minimum((upto * MOST_VALUES) // upto[-1], MOST_VALUES - 1)
    last = np.append(group[1:] != group[:-1], True)
    return values[last], np.diff(upto[last], prepend=0)


def _merged(a: Counted, b: Counted) -> Counted:
    out = []
    for (v, n), (w, m) in zip(a, b):
        values, place = np.unique(np.concatenate([v, w]), return_inverse=True)
        out.append(_thinned(values, np.bincount(place, np.concatenate([n, m])).astype(np.int64)))
    return out


def _splits(values: np.ndarray, counts: np.ndarray, rows: int) -> np.ndarray:
    """Up to 31 limits between values, with about as many rows between one and the next."""
    between = (values[:-1] + values[1:]) / 2.0
    most = min(MAX_BINS, rows) - 1
    if len(between) <= most:
        return between
    stride = counts.sum() / (most + 1)
    target, out, upto = stride, [], np.cumsum(counts)
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of a task as (values, label, held out), many batches at a time."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield _matrix(some, n)
            some, n = [], 0
    if n:
        yield _matrix(some, n)


def _matrix(batches: list[pa.RecordBatch], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(batches).combine_chunks()
    x = pa.concat_arrays(c.flatten() for c in t["x"].chunks).to_numpy().reshape(n, -1)
    return x, t["y"].to_numpy(), t["held"].to_numpy()


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, rows = None, 0
    for x, y, held in _matrices(batches):
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("boosting needs labels of 0 and 1")
        rows += len(x)
        x = x[~held]
        if len(x):
            counted = [_thinned(*np.unique(c, return_counts=True)) for c in x.T]
            found = counted if found is None else _merged(found, counted)
    yield pa.RecordBatch.from_pydict({"found": [pickle.dumps((rows, found))]})


def _joined(a: tuple[int, Counted | None], b: tuple[int, Counted | None]) -> tuple[int, Counted | None]:
    both = _merged(a[1], b[1]) if a[1] and b[1] else a[1] or b[1]
    return a[0] + b[0], both


def _into_blocks(splits: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x, y, held in _matrices(batches):
        order = np.argsort(held, kind="stable")
        bins = [np.searchsorted(s, c[order]).astype(np.uint16) for s, c in zip(splits, x.T)]
        bins += [np.zeros(len(x), np.uint16)] * (len(bins) % 2)
        pairs = np.stack([a * MAX_BINS + b for a, b in zip(bins[::2], bins[1::2])])
        label = np.where(y[order] > 0, 1, -1).astype(np.int8)
        yield pa.RecordBatch.from_pydict({"block": [pickle.dumps((pairs, label, int((~held).sum())))]})


def _blocks(rows: DataFrame) -> tuple[RDD, list[np.ndarray]]:
    """The rows in blocks of bins, and the limits between the bins of each column."""
    plain = rows.select(
        vector_to_array("x").alias("x"), F.col("etiqueta").cast("double").alias("y"), F.col("es_freno").alias("held")
    )
    spark = rows.sparkSession
    found = plain.mapInArrow(_count_values, "found BINARY").rdd.map(lambda r: pickle.loads(r["found"]))
    n, values = found.treeReduce(_joined)
    if values is None:
        raise ValueError("boosting needs rows that are not held out")
    fitted = int(values[0][1].sum())
    splits = [_splits(v, c, fitted) for v, c in values]
    parts = max(min(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), -(-n // ALONE)) if n > ALONE else 1
    made = plain.coalesce(parts).mapInArrow(lambda it: _into_blocks(splits, it), "block BINARY").rdd

    def opened(part: int, found: Iterator) -> Iterator[Block]:
        for i, r in enumerate(found):
            pairs, label, fitted = pickle.loads(r["block"])
            yield Block(part * 1_000_000 + i, pairs, label, fitted, np.zeros(len(label)))

    return made.mapPartitionsWithIndex(opened), splits


# one level -------------------------------------------------------------------------------------


def _count_level(blocks: Iterable[Block], tree: Tree, level: int, nodes: Sequence[int], n: int, how: Settings) -> Counts:
    """Rows and sums per column and bin of some nodes of a level, and at the end the sum of squares.

    Before a tree also the held-out loss, and the squares of the tree before.
    """
    slot = np.full(2 ** (level + 1), -1)
    slot[list(nodes)] = np.arange(len(nodes))
    out, total, squares = {}, None, np.zeros(len(nodes))
    for block in blocks:
        if level == 0:
            _add(out, block.ended())
        rows, at = block.nodes(tree, level, n, how)
        if total is None:
            total = np.zeros((len(nodes), 2, 2 * len(block.pairs), MAX_BINS))
        mine = slot.take(at)
        if level:
            some = np.flatnonzero(mine >= 0)
            rows, mine = rows.take(some), mine.take(some)
        wanted = block.wanted(n == 0, rows)
        squares += np.bincount(mine, wanted * wanted, len(nodes))
        mine *= MAX_BINS * MAX_BINS
        for i, pair in enumerate(block.pairs):
            key = pair.take(rows) + mine
            for what, weight in enumerate((None, wanted)):
                both = np.bincount(key, weight, len(nodes) * MAX_BINS * MAX_BINS).reshape(-1, MAX_BINS, MAX_BINS)
                total[:, what, 2 * i] += both.sum(axis=2)
                total[:, what, 2 * i + 1] += both.sum(axis=1)
    if total is not None:
        out |= {node: np.append(total[i].ravel(), squares[i]) for i, node in enumerate(nodes) if total[i, 0, 0].any()}
    return out


def _add(total: Counts, some: Counts) -> Counts:
    for key, counted in some.items():
        total[key] = total[key] + counted if key in total else counted
    return total


def _other(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The counts of a node's other child."""
    out = parent - child
    rows, sums = out[:-1].reshape(2, -1)
    sums[rows == 0] = 0.0  # not a trace of rounding
    return out


def _choose(node: int, counts: np.ndarray, columns: int, n: int, how: Settings) -> tuple:
    """(its sums, gain, column, cut, rows and sums of both sides); without a split the column is -1."""
    counted, squares = counts[:-1].reshape(2, -1, MAX_BINS)[:, :columns], counts[-1]
    rows, total = counted[:, 0].sum(axis=1)
    left = np.cumsum(counted, axis=2)[:, :, :-1]
    right = counted.sum(axis=2)[:, :, None] - left
    used = np.random.default_rng((how.seed, n, node)).permutation(columns)[: math.ceil(how.columns * columns)]
    fits = (left[0] >= how.least) & (right[0] >= how.least)
    fits &= np.isin(np.arange(columns), used)[:, None]
    of = lambda side: side[1] ** 2 / np.maximum(side[0], 1)
    gain = np.where(fits, (of(left) + of(right) - total**2 / rows) / rows, 0.0)
    # of gains that differ by rounding only, the first
    column, cut = divmod(int((gain >= gain.max() * (1 - ROUNDING)).argmax()), gain.shape[1])
    impurity = squares / rows - (total / rows) ** 2
    if gain[column, cut] <= 0 or impurity < max(TINY, ROUNDING * squares / rows):
        return (rows, total, squares), 0.0, -1, 0, None, None
    return (rows, total, squares), float(gain[column, cut]), column, cut, left[:, column, cut], right[:, column, cut]


class _Alone:
    """The blocks of one task, which fits all trees."""

    def __init__(self, blocks: Iterable[Block], how: Settings):
        self.blocks, self.how = list(blocks), how

    def count(self, *level) -> Counts:
        return _count_level(self.blocks, *level, self.how)

    def move(self, trees: Sequence[Tree], weights: Sequence[float]) -> None:
        self.blocks = [b.moved(trees[-1:], weights, self.how) for b in self.blocks]

    def end(self) -> Counts:
        return functools.reduce(_add, (b.ended() for b in self.blocks), {})


class _Spread:
    """The blocks of many tasks, kept with their scores from tree to tree."""

    def __init__(self, blocks: RDD, how: Settings):
        self.start = self.state = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.held, self.how = [self.start], how

    def count(self, *level) -> Counts:
        how, parts, nodes = self.how, self.state.getNumPartitions(), level[2]
        counted = self.state.mapPartitions(lambda blocks: _count_level(blocks, *level, how).items())
        if parts * len(nodes) > MOST_COLLECTED:
            counted = counted.reduceByKey(np.add, min(parts, len(nodes)))
        total = {}
        for key, some in counted.collect():
            _add(total, {key: some})
        if level[1] == 0:
            for old in self.held[1:-1]:  # the present scores are kept by now, and the last ones are not needed
                old.unpersist()
            self.held = [self.start, self.state] if self.state is not self.start else [self.start]
        return total

    def move(self, trees: Sequence[Tree], weights: Sequence[float]) -> None:
        how, weights = self.how, tuple(weights)
        some, of = (trees[-1:], self.state) if len(trees) % CHAIN else (tuple(trees), self.start)
        self.state = of.map(lambda b: b.moved(some, weights, how)).persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(self.state)

    def end(self) -> Counts:
        return self.state.map(lambda b: b.ended()).treeReduce(_add)

    def drop(self) -> None:
        for old in {id(r): r for r in (*self.held, self.state)}.values():
            old.unpersist()


def _grown(on: _Alone | _Spread, n: int, columns: int, enough, before: Sequence[Tree]) -> Tree | None:
    """A tree, level by level, or none if the held-out loss before it is `enough`.

    Of two children the one with fewer rows is counted; the counts of the other are what is left of their parent's.
    """
    tree, nodes, above = Tree.empty(on.how.depth), [1], {}
    for level in range(on.how.depth):
        counted = on.count(tree, level, nodes, n)
        if level == 0 and _seen(counted, before, enough):
            return None
        found = {node: counted[node] for node in nodes if node in counted}
        if level:
            found |= {node ^ 1: _other(above[node // 2], counts) for node, counts in found.items()}
        nodes, above = [], found
        for node, counts in found.items():
            tree.sums[node], gain, column, cut, left, right = _choose(node, counts, columns, n, on.how)
            if column >= 0:
                tree.column[node], tree.cut[node], tree.gain[node] = column, cut, gain
                tree.sums[2 * node, :2], tree.sums[2 * node + 1, :2] = left, right
                nodes.append(2 * node + int(right[0] < left[0]))
        if not nodes:
            break
    return tree


def _seen(counted: Counts, before: Sequence[Tree], enough) -> bool:
    """Takes what a pass says of the trees before it: the squares of the last one's leaves, and the held-out loss."""
    if before and SQUARES in counted:
        lowest = len(before[-1].column) // 2
        before[-1].sums[lowest:, 2] = counted[SQUARES][lowest:]
    return enough(counted[LOSS])


class _Stop:
    """Whether the held-out loss has stopped to fall, as of `GBTClassifier`: by less than tol of itself."""

    def __init__(self, tol: float):
        self.tol, self.best, self.trees, self.seen = tol, math.inf, 0, 0

    def __call__(self, loss: np.ndarray) -> bool:
        """Takes the loss after 0, 1, 2, ... trees."""
        after, self.seen = self.seen, self.seen + 1
        if not after:
            return False
        now = loss[0] / loss[1] if loss[1] else -math.inf  # nothing is held out: no stop
        if after > 1 and loss[1] and self.best - now < self.tol * max(now, 0.01):
            return True
        self.best, self.trees = now, after
        return False


def _boosted(on: _Alone | _Spread, trees: int, step: float, tol: float, columns: int) -> tuple[list[Tree], list[float]]:
    found, weights, stop = [], [], _Stop(tol)
    for n in range(trees):
        tree = _grown(on, n, columns, stop, found)
        if tree is None:
            break
        found.append(tree)
        weights.append(1.0 if n == 0 else step)
        on.move(found, weights)
    else:
        _seen(on.end(), found, stop)
    return found[: stop.trees], weights[: stop.trees]


def fit(
    rows: DataFrame, trees: int, seed: int, tol: float, stepSize: float, maxDepth: int, minInstancesPerNode: int,
    subsamplingRate: float, featureSubsetStrategy: str,
) -> GBTClassificationModel:
    """Fit on (x, etiqueta, es_freno): up to `trees` trees, fewer if the rows marked es_freno gain less than `tol`.

    Rows that are no more than a task has in any case are fitted by one task, which starts no job per level.
    """
    spark = rows.sparkSession
    deploy(spark)
    share = 1.0 if featureSubsetStrategy in ("all", "auto") else float(featureSubsetStrategy)
    how = Settings(maxDepth, minInstancesPerNode, subsamplingRate, share, seed)
    made, splits = _blocks(rows)
    if made.getNumPartitions() == 1:
        found = made.mapPartitions(lambda it: [_boosted(_Alone(it, how), trees, stepSize, tol, len(splits))]).first()
    else:
        on = _Spread(made, how)
        try:
            found = _boosted(on, trees, stepSize, tol, len(splits))
        finally:
            on.drop()
    return _model(spark, *found, splits)


def _model(spark: SparkSession, trees: Sequence[Tree], weights: Sequence[float], splits: list[np.ndarray]) -> GBTClassificationModel:
    """The trees as a model of pyspark.ml, which scores, saves and weighs columns."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    ml, regression = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression
    sums = jvm.org.apache.spark.mllib.tree.impurity.VarianceAggregator()

    def doubles(values) -> object:
        return jvm.org.apache.spark.mllib.linalg.Vectors.parse(f"[{','.join(repr(float(v)) for v in values)}]").toArray()

    def opened(tree: Tree) -> object:
        stats = doubles(np.column_stack([tree.sums, tree.sums[:, 0]]).ravel())
        rows, total, squares = tree.sums.T
        impurity = squares / np.maximum(rows, 1) - tree.values() ** 2

        def node(i: int) -> object:
            own = sums.getCalculator(stats, 4 * i)
            value, spare = float(tree.values()[i]), max(float(impurity[i]), 0.0)
            if tree.column[i] < 0:
                return ml.LeafNode(value, spare, own)
            column = int(tree.column[i])
            split = ml.ContinuousSplit(column, float(splits[column][tree.cut[i]]))
            return ml.InternalNode(value, spare, float(tree.gain[i]), node(2 * i), node(2 * i + 1), split, own)

        return regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", node(1), len(splits))

    array = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = opened(tree)
    model = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"GBTClassifier_{uuid.uuid4().hex[:12]}", array, doubles(weights), len(splits), 2
    )
    return GBTClassificationModel(model).setFeaturesCol("x")
