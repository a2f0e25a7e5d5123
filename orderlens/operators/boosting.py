"""Gradient-boosted trees over coded columns, with the splits that ``GBTClassifier`` makes of their vectors.

Bins of a numeric are split in the order of their means, a one-hot slot splits its category from all
others. So the sums of a column's values are all that its slots need: a row adds to one cell a column
and not to one a slot. Columns are put together as
long as the product of their sizes stays small, which makes a handful of cells a row. Rows lie in
blocks of ``uint16`` codes with their scores so far; each pass sends the sums of a tree's open nodes.
The result is the library's own model.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession

#: Cells of columns that are counted together, and rows of a block.
CELLS, BLOCK_ROWS = 4096, 1 << 14
#: Trees after which the rows' scores are brought up to date; in between they are added in each pass.
FRESH = 5
#: Gains that differ by less than this share of the largest are ties, which go to the first slot.
TIE = 1e-10
EPSILON = np.finfo(float).eps


@dataclass
class Split:
    """A column with its codes that go right, the same as values of a slot that go left, and the sums of both sides."""

    gain: float
    column: int
    right_codes: np.ndarray
    slot: int
    left_values: list[float]
    arity: int
    left: np.ndarray
    right: np.ndarray


class Columns:
    """Sizes of the coded columns, numerics (bins) before categories, and how they are counted together."""

    def __init__(self, numerics: list[int], categories: list[int]):
        self.sizes = [*numerics, *(n + 1 for n in categories)]  # a value that is no label of its category has no slot
        self.n_numerics = len(numerics)
        self.first = [*range(len(numerics)), *(len(numerics) + int(x) for x in np.cumsum([0, *categories])[:-1])]
        self.n_slots = len(numerics) + sum(categories)
        self.groups: list[list[int]] = []
        for c, n in enumerate(self.sizes):
            if self.groups and np.prod([self.sizes[k] for k in self.groups[-1]]) * n <= CELLS:
                self.groups[-1].append(c)
            else:
                self.groups.append([c])

    def shape(self, group: int) -> tuple[int, ...]:
        return tuple(self.sizes[c] for c in self.groups[group])

    def joint(self, codes: np.ndarray) -> np.ndarray:
        """The codes (a row for each column) of each group of columns as one number."""
        made = [np.ravel_multi_index([codes[c] for c in cs], self.shape(g)) for g, cs in enumerate(self.groups)]
        return np.array(made, dtype=np.uint16 if max(np.prod(self.shape(g)) for g in range(len(self.groups))) <= 1 << 16 else np.uint32)

    def goes_right(self, split: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        """The group that a split (a column and which of its codes go right) looks at, and which of its numbers do."""
        column, right = split
        group = next(g for g, cs in enumerate(self.groups) if column in cs)
        return group, right[np.unravel_index(np.arange(int(np.prod(self.shape(group)))), self.shape(group))[self.groups[group].index(column)]]

    def cells(self, nodes: int) -> list[np.ndarray]:
        """Empty sums of three values by node and number, for each group."""
        return [np.zeros((3, nodes * int(np.prod(self.shape(g))))) for g in range(len(self.groups))]

    def add(self, cells: list[np.ndarray], joint: np.ndarray, node: np.ndarray, values: list[np.ndarray]) -> None:
        for g, held in enumerate(cells):
            at = joint[g].astype(np.int64)
            if node.any():
                at += node * int(np.prod(self.shape(g)))
            for k, value in enumerate(values):
                held[k] += np.bincount(at, value, held.shape[1])

    def by_code(self, cells: list[np.ndarray], nodes: int) -> np.ndarray:
        """Sums by value, node and code, the columns side by side."""
        made = np.zeros((3, nodes, sum(self.sizes)))
        ends = np.cumsum([0, *self.sizes])
        for g, cs in enumerate(self.groups):
            held = cells[g].reshape(3, nodes, *self.shape(g))
            for axis, c in enumerate(cs):
                made[:, :, ends[c] : ends[c + 1]] = held.sum(axis=tuple(a + 2 for a in range(len(cs)) if a != axis))
        return made

    def tables(self, splits: list[dict]) -> list[list[tuple]]:
        """Each level's splits as (node, group, which of its numbers go right)."""
        return [[(k, *self.goes_right(split)) for k, split in level.items()] for level in splits]


def descend(levels: list[list[tuple]], joint: np.ndarray) -> np.ndarray:
    """The node of the last level that each row is in, by the ``tables`` of a tree; nodes without a split lead left."""
    node = np.zeros(joint.shape[1], dtype=np.int64)
    for level in levels:
        right = np.zeros(len(node), dtype=bool)
        for k, group, table in level:
            right |= (node == k) & table[joint[group]]
        node = 2 * node + right
    return node


def _raised(trees: list[tuple], joint: np.ndarray, score: np.ndarray) -> np.ndarray:
    for levels, values in trees:
        score = score + values[descend(levels, joint)]
    return score


def blocks_of(rows: DataFrame, columns: Columns) -> RDD:
    """Joint codes, labels of -1 and 1, weights and scores of some rows each, persisted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                codes = part.column(0).flatten().to_numpy().reshape(part.num_rows, -1).T
                if (codes >= np.array(columns.sizes)[:, None]).any():
                    raise ValueError("a missing number has no bin to train on")
                label, weight = (part.column(k).to_numpy() for k in (1, 2))
                block = (columns.joint(codes), 2.0 * label - 1.0, weight, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, protocol=5)], pa.binary())], names=["block"])

    packed = rows.select("codes", "label", "n_equal").mapInArrow(run, "block binary")
    # The hundreds of short passes go over an RDD, which needs no plan for each.
    return packed.rdd.map(lambda row: pickle.loads(row.block)).persist(StorageLevel.MEMORY_AND_DISK)


def _pass(blocks: RDD, columns: Columns, trees: list[tuple], splits: list[dict], first: bool) -> np.ndarray:
    """Sums of weights, residuals and their squares of the open level's nodes, by code."""
    nodes = 1 << len(splits)

    def run(held: Iterator[tuple]) -> Iterator[np.ndarray]:
        cells, levels = columns.cells(nodes), columns.tables(splits)
        before = [(columns.tables(made), values) for made, values in trees]
        for joint, label, weight, score in held:
            score = _raised(before, joint, score)
            # The loss is 2 log(1 + exp(-2 y F)); the first tree fits the labels themselves.
            with np.errstate(over="ignore"):
                rest = label if first else 4.0 * label / (1.0 + np.exp(2.0 * label * score))
            first_moment = weight * rest
            columns.add(cells, joint, descend(levels, joint), [weight, first_moment, first_moment * rest])
        yield columns.by_code(cells, nodes)

    # An array of a few ten thousand bytes for each partition.
    return sum(blocks.mapPartitions(run).collect())


def _impurity(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (q - s * s / n) / n, 0.0)


def best_split(columns: Columns, sums: np.ndarray) -> Split | None:
    """The best split of one node by its ``sums`` (3, codes), None without a gain.

    Slots stand in the order of the vectors, the first of the best wins.
    """
    ends, found = np.cumsum([0, *columns.sizes]), []
    whole = sums[:, : ends[1]].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c, size in enumerate(columns.sizes):
            mine = sums[:, ends[c] : ends[c + 1]]
            if c < columns.n_numerics:
                order = np.argsort(np.where(mine[0] > 0, mine[1] / mine[0], np.inf), kind="stable")
                left = np.cumsum(mine[:, order], axis=1)
                found += [(c, order[: k + 1], left[:, k]) for k in range(size - 1)]
            else:
                rest = whole[:, None] - mine
                lower = (mine[0] > 0.5) & ~(rest[1] / rest[0] <= mine[1] / mine[0])
                found += [(c, (v, bool(lower[v])), mine[:, v] if lower[v] else rest[:, v]) for v in range(size - 1)]
        if not found:
            return None
        left = np.array([f[2] for f in found]).T
        right = whole[:, None] - left
        n = left[0] + right[0]
        gain = _impurity(*whole) - left[0] / n * _impurity(*left) - right[0] / n * _impurity(*right)
    # Weights are whole numbers, so an empty side is below a half.
    gain = np.where((left[0] < 0.5) | (right[0] < 0.5) | ~(gain > 0), -np.inf, gain)
    if not np.isfinite(gain.max()):
        return None
    best = int(np.flatnonzero(gain >= gain.max() * (1 - TIE))[0])
    c, lower, _ = found[best]
    goes = np.ones(columns.sizes[c], dtype=bool)
    if c < columns.n_numerics:
        goes[lower] = False
        slot, values, arity = c, [float(v) for v in lower], columns.sizes[c]
    else:
        v, is_left = lower
        goes = (np.arange(columns.sizes[c]) == v) != is_left
        slot, values, arity = columns.first[c] + v, [float(is_left)], 2
    return Split(float(gain[best]), c, goes, slot, values, arity, left[:, best], right[:, best])


class Tree:
    """A regression tree: nodes by (level, place), each with its sums, and a split where it has one."""

    def __init__(self, depth: int):
        self.depth, self.splits, self.stats, self.chosen = depth, [], {}, {}

    def values(self) -> np.ndarray:
        """The prediction of each node of the last level; leaves above it stand for all below them."""
        made = np.zeros(1 << self.depth)
        for k in range(len(made)):
            level, place = self.depth, k
            while (level, place) not in self.stats:
                level, place = level - 1, place >> 1
            n, s, _ = self.stats[level, place]
            made[k] = s / n if n else 0.0
        return made


def _grown(blocks: RDD, columns: Columns, trees: list[tuple], depth: int, first: bool) -> Tree:
    tree = Tree(depth)
    open_nodes = [0]
    while len(tree.splits) < depth and open_nodes:
        level = len(tree.splits)
        sums = _pass(blocks, columns, trees, tree.splits, first)
        if level == 0:
            tree.stats[0, 0] = sums[:, 0, : columns.sizes[0]].sum(axis=1)
        here, below = {}, []
        for k in open_nodes:
            found = best_split(columns, sums[:, k])
            if found is None:
                continue
            here[k] = (found.column, found.right_codes)
            tree.chosen[level, k] = found
            for place, stats in ((2 * k, found.left), (2 * k + 1, found.right)):
                tree.stats[level + 1, place] = stats
                if abs(_impurity(*stats)) >= EPSILON:
                    below.append(place)
        tree.splits.append(here)
        open_nodes = below
    tree.splits += [{}] * (depth - len(tree.splits))
    return tree


def _java_tree(spark: SparkSession, tree: Tree, n_slots: int, uid: str):
    ml, gateway = spark._jvm.org.apache.spark.ml, spark.sparkContext._gateway

    def doubles(values: list[float]):
        made = gateway.new_array(gateway.jvm.double, len(values))
        for k, value in enumerate(values):
            made[k] = value
        return made

    def node(level: int, place: int):
        n, s, q = (float(x) for x in tree.stats[level, place])
        calculator = spark._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(doubles([n, s, q]), int(round(n)))
        value, impurity = (s / n if n else 0.0), float(_impurity(n, s, q))
        if (level, place) not in tree.chosen:
            return ml.tree.LeafNode(value, impurity, calculator)
        found = tree.chosen[level, place]
        split = ml.tree.CategoricalSplit(found.slot, doubles(found.left_values), found.arity)
        return ml.tree.InternalNode(value, impurity, found.gain, node(level + 1, 2 * place), node(level + 1, 2 * place + 1), split, calculator)

    return ml.regression.DecisionTreeRegressionModel(uid, node(0, 0), n_slots)


class CodedBoosting:
    """Fits what ``GBTClassifier`` with the same options fits, on ``codes, label, n_equal``; set ``columns`` before."""

    columns: Columns | None = None

    def __init__(self, **options):
        self.plain = GBTClassifier(**options)

    def fit(self, rows: DataFrame) -> GBTClassificationModel:
        spark, option = rows.sparkSession, lambda name: self.plain.getOrDefault(getattr(self.plain, name))
        depth, step = option("maxDepth"), option("stepSize")
        blocks = blocks_of(rows, self.columns)
        if not blocks.count():
            raise ValueError("no rows to train on")
        trees, late = [], []
        for k in range(option("maxIter")):
            tree = _grown(blocks, self.columns, late, depth, k == 0)
            trees.append(tree)
            late.append((tree.splits, (1.0 if k == 0 else step) * tree.values()))
            if len(late) == FRESH:
                older, blocks = blocks, _raised_blocks(blocks, self.columns, late)
                older.unpersist()
                late = []
        blocks.unpersist()
        gateway, jvm = spark.sparkContext._gateway, spark._jvm
        made = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
        weights = gateway.new_array(gateway.jvm.double, len(trees))
        for k, tree in enumerate(trees):
            made[k] = _java_tree(spark, tree, self.columns.n_slots, f"dtr_{self.plain.uid}_{k}")
            weights[k] = 1.0 if k == 0 else step
        model = jvm.org.apache.spark.ml.classification.GBTClassificationModel(self.plain.uid, made, weights, self.columns.n_slots, 2)
        self.plain._transfer_params_to_java()
        self.plain._java_obj.copyValues(model, self.plain._java_obj.extractParamMap())
        return GBTClassificationModel(model)


def _raised_blocks(blocks: RDD, columns: Columns, trees: list[tuple]) -> RDD:
    """The blocks with the trees added to their scores, made and persisted."""

    def run(held: Iterator[tuple]) -> Iterator[tuple]:
        before = [(columns.tables(made), values) for made, values in trees]
        for joint, label, weight, score in held:
            yield joint, label, weight, _raised(before, joint, score)

    made = blocks.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)
    made.foreachPartition(lambda held: sum(1 for _ in held))
    return made
