"""Second-order boosted trees for two classes, grown level by level from histograms that Spark adds up.

Each row has a gradient g = p - y and a hessian h = p (1 - p) of the log loss at its present margin. With G and H their sums over
the rows of a node, a leaf's weight is -G / (H + l2) times the rate, and a split gains

    G_left^2 / (H_left + l2) + G_right^2 / (H_right + l2) - G^2 / (H + l2).

*Bins.* A feature is cut at quantiles that one aggregation finds, so that what a row is to the trees is a short vector of bin
numbers; bin 0 holds missing values, which go to the side where they gain more. Rows with equal bins and labels are the same row
to all trees: they are counted once, and every later pass reads the distinct ones with their weights.

*Passes.* A level of a tree is one pass: each task adds its rows into a histogram by (node, feature, bin), Spark adds the tasks'
histograms up, and only the sums reach the driver: nodes of the level x features x bins, whatever the rows. A pass is one short
job over kept arrays, as there are some hundred of them and the planning of a query would take longer than the pass. Margins are
kept as well, a tree further after each tree, and written every ``ROUNDS_A_TABLE`` rounds, so that a lost executor costs no more than these.

Gradients are added as whole numbers of a fixed step, so sums are the same in any order: partitioning, retries and lost executors
change no split. Labels are 0 or 1. A table without rows can't be learned from and is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialize

ROUNDS_A_TABLE = 20
CHUNK_ROWS = 1 << 18  # rows that a task holds at a time
DIRECT_TASKS = 64  # more tasks' histograms than this are added up in two steps
KNOWN_ROWS = 1 << 20  # different rows whose margins a task keeps when it predicts
LEAST_GAIN = 1e-6
LEAF = -1

Tree = dict[str, list]
#: bins, labels, weights and margins of some rows
Chunk = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def new_tree() -> Tree:
    """A tree of one leaf. A row goes left if its bin is at most ``cut``, or where ``missing_left`` says so if it is missing."""
    return {"feature": [LEAF], "cut": [0], "missing_left": [False], "left": [0], "right": [0], "value": [0.0], "gain": [0.0]}


def _split(tree: Tree, node: int, feature: int, cut: int, missing_left: bool, gain: float) -> tuple[int, int]:
    """Give a leaf two children and return them."""
    left = len(tree["feature"])
    for name, value in (("feature", feature), ("cut", cut), ("missing_left", missing_left), ("left", left),
                        ("right", left + 1), ("gain", gain)):
        tree[name][node] = value
    for name, value in new_tree().items():
        tree[name] += value * 2
    return left, left + 1


def leaf_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf that each row of bin numbers ends in."""
    feature, cut, missing_left, left, right = (np.array(tree[c]) for c in ("feature", "cut", "missing_left", "left", "right"))
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while (inner := feature[at] != LEAF).any():
        value = bins[rows, np.maximum(feature[at], 0)]
        goes_left = np.where(value == 0, missing_left[at], value <= cut[at])
        at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
    return at


def margins(trees: list[Tree], bins: np.ndarray, start: np.ndarray | float) -> np.ndarray:
    """``start`` plus the weights of the leaves that each row ends in."""
    total = np.zeros(len(bins)) + start
    for tree in trees:
        total += np.array(tree["value"])[leaf_of(tree, bins)]
    return total


class KnownMargins:
    """Margins of rows of bin numbers: rows with equal bins go down the trees once and are looked up from then on.

    Up to ``KNOWN_ROWS`` different rows are kept; when they are more, all are forgotten and it starts anew.
    """

    def __init__(self, trees: list[Tree], base: float):
        self.trees, self.base = [{c: np.array(v) for c, v in tree.items()} for tree in trees], base
        self.codes, self.margins = None, np.empty(0)

    def of(self, bins: np.ndarray) -> np.ndarray:
        if not len(bins):
            return np.empty(0)
        if bins.shape[1] <= 4:  # a row is one number
            wide = np.zeros((len(bins), 4), np.uint16)
            wide[:, :bins.shape[1]] = bins
            codes, first, row = np.unique(wide.view(np.uint64)[:, 0], return_index=True, return_inverse=True)
        else:
            raw = np.ascontiguousarray(bins).view(f"S{bins.itemsize * bins.shape[1]}")[:, 0]
            codes, first, row = np.unique(raw, return_index=True, return_inverse=True)
        if self.codes is None or len(self.codes) > KNOWN_ROWS:
            self.codes, self.margins = codes[:0], np.empty(0)
        at = np.searchsorted(self.codes, codes)
        new = np.ones(len(codes), bool)
        inside = at < len(self.codes)
        new[inside] = self.codes[at[inside]] != codes[inside]
        if new.any():
            self.margins = np.insert(self.margins, at[new], margins(self.trees, bins[first[new]], self.base))
            self.codes = np.insert(self.codes, at[new], codes[new])
            at = np.searchsorted(self.codes, codes)
        return self.margins[at][row]


def to_bins(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin numbers of a matrix of features: 0 if missing, else 1 and the edges that are not above the value."""
    out = np.zeros(x.shape, np.uint16)
    for f, cuts in enumerate(edges):
        known = ~np.isnan(x[:, f])
        out[known, f] = 1 + np.searchsorted(np.array(cuts), x[known, f], side="right")
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(-1, width)


def _bins_of(column: pa.Array, width: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:][:len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view("<u2").reshape(-1, width)


def quantile_edges(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Ascending distinct cut values of each feature of the array column ``x``, missing values left out; one aggregation."""
    shares = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    known = [F.when(~F.isnan(F.col("x")[f]), F.col("x")[f]) for f in range(width)]
    found = rows.agg(*[F.percentile_approx(c, shares, F.lit(10 * max(bins, 1000))).alias(f"f{f}") for f, c in enumerate(known)]).first()
    return [sorted(set(found[f"f{f}"] or [])) for f in range(width)]


def binned_rows(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """(bins, y, w): distinct rows of bin numbers (little-endian, two bytes each) with label and weight."""
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = to_bins(_matrix(batch.column(0), width), edges).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["bins", "y"])

    return rows.select("x", "y").mapInArrow(run, "bins binary, y int").groupBy("bins", "y").agg(F.count("*").alias("w"))


def dealt_rows(table: DataFrame, width: int) -> RDD:
    """The rows of (bins, y, w, margin) as chunks of arrays, dealt over all cores and kept."""
    names = ["bins", "y", "w", "margin"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            parts = [np.concatenate([_bins_of(b.column(0), width) for b in held])]
            parts += [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (1, 2, 3)]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=names)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                yield chunk()
                held.clear()
        if held:
            yield chunk()

    def arrays(row) -> Chunk:
        return (np.frombuffer(row.bins, "<u2").reshape(-1, width), np.frombuffer(row.y, np.int32),
                np.frombuffer(row.w, np.int64), np.frombuffer(row.margin))

    dealt = table.select(names).repartition(table.sparkSession.sparkContext.defaultParallelism)
    packed = dealt.mapInArrow(pack, ", ".join(f"{n} binary" for n in names))
    return packed.rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)


def with_tree(chunks: RDD, tree: Tree) -> RDD:
    """The same rows, kept, with the tree's weights added to their margins."""

    def further(chunk: Chunk) -> Chunk:
        bins, y, w, margin = chunk
        return bins, y, w, margins([tree], bins, margin)

    return chunks.map(further).persist(StorageLevel.MEMORY_AND_DISK)


def level_histogram(chunks: RDD, tree: Tree, frontier: list[int], width: int, depth: int, step: float) -> np.ndarray:
    """Sums of gradients and hessians by (node of ``frontier``, feature, bin), in whole steps.

    ``depth`` is one more than the largest bin number.
    """
    shape = (len(frontier), width, depth)
    size = int(np.prod(shape))

    def run(held: Iterator[Chunk]) -> Iterator[np.ndarray]:
        sums = np.zeros((2, size), np.int64)
        place = np.full(len(tree["feature"]), -1)
        place[frontier] = np.arange(len(frontier))
        for bins, y, w, margin in held:
            at = place[leaf_of(tree, bins)]
            here = at >= 0
            at, bins, y, w, margin = (x[here] for x in (at, bins, y, w, margin))
            p = 1 / (1 + np.exp(-margin))
            g, h = (w * np.rint(v / step).astype(np.int64) for v in (p - y, p * (1 - p)))
            for f in range(width):
                slot = (at * width + f) * depth + bins[:, f]
                np.add.at(sums[0], slot, g)
                np.add.at(sums[1], slot, h)
        yield sums

    parts = chunks.mapPartitions(run)
    sums = parts.reduce(np.add) if parts.getNumPartitions() <= DIRECT_TASKS else parts.treeReduce(np.add)
    return np.ascontiguousarray(sums.T).reshape(*shape, 2) * step


def best_split(histogram: np.ndarray, l2: float, least_hessian: float) -> tuple[float, int, int, bool, np.ndarray, np.ndarray] | None:
    """(gain, feature, cut, missing go left, sums left, sums right) of a node, or None; ties go to the first feature and cut."""
    total = histogram[0].sum(axis=0)

    def worth(sums: np.ndarray) -> np.ndarray:
        return sums[..., 0] ** 2 / np.maximum(sums[..., 1] + l2, 1e-300)

    left = np.cumsum(histogram[:, 1:], axis=1)[:, :-1]  # a cut after the last bin divides nothing
    left = np.stack((left, left + histogram[:, :1]), axis=2)  # missing values right, left
    right = total - left
    gain = worth(left) + worth(right) - worth(total)
    allowed = (left[..., 1] >= least_hessian) & (right[..., 1] >= least_hessian) & (left[..., 1] > 0) & (right[..., 1] > 0)
    gain = np.where(allowed, gain, -np.inf)
    if not gain.size or gain.max() <= LEAST_GAIN:
        return None
    # equal up to rounding counts as equal, so that the first wins
    f, c, m = np.unravel_index(np.argmax(gain >= gain.max() * (1 - 1e-12)), gain.shape)
    return float(gain[f, c, m]), int(f), int(c) + 1, bool(m), left[f, c, m], right[f, c, m]


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Second-order boosting with the customary defaults: 100 rounds, depth 6, rate 0.3, L2 weight 1, hessian of a child at least 1."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", rounds: int = 100,
                 maxDepth: int = 6, rate: float = 0.3, l2: float = 1.0, leastGain: float = 0.0, leastHessian: float = 1.0,
                 bins: int = 256, baseScore: float = 0.5):
        super().__init__()
        given = dict(self._input_kwargs)
        self._set(**{c: given[c] for c in ("featuresCol", "labelCol", "predictionCol") if c in given})
        if not 2 <= bins <= 60_000:
            raise ValueError("bins must lie between 2 and 60,000")
        self.rounds, self.max_depth, self.rate, self.l2, self.bins = rounds, maxDepth, rate, l2, bins
        self.least_gain, self.least_hessian, self.base_score = leastGain, leastHessian, baseScore

    def _grow(self, rows: RDD, width: int, depth: int, step: float) -> Tree:
        """One tree, a pass a level."""
        tree, frontier = new_tree(), [0]
        for level in range(self.max_depth):
            sums = level_histogram(rows, tree, frontier, width, depth, step)
            following = []
            for node, histogram in zip(frontier, sums, strict=True):
                if level == 0:
                    tree["value"][node] = self._weight(histogram[0].sum(axis=0))
                found = best_split(histogram, self.l2, self.least_hessian)
                if found is None or found[0] < self.least_gain:
                    continue
                gain, feature, cut, missing_left, *children = found
                for child, child_sums in zip(_split(tree, node, feature, cut, missing_left, gain), children, strict=True):
                    tree["value"][child] = self._weight(child_sums)
                    if child_sums[1] >= 2 * self.least_hessian:  # else no two children can have enough
                        following.append(child)
            frontier = following
            if not frontier:
                break
        return tree

    def _more_trees(self, table: DataFrame, rounds: int, width: int, depth: int, step: float) -> list[Tree]:
        """The next trees after the margins of the table."""
        kept = [dealt_rows(table, width)]
        try:
            trees = [self._grow(kept[0], width, depth, step)]
            while len(trees) < rounds:
                kept.append(with_tree(kept[-1], trees[-1]))
                trees.append(self._grow(kept[-1], width, depth, step))
                kept.pop(0).unpersist()  # the first pass over its successor has read it
        finally:
            for rows in kept:
                rows.unpersist()
        return trees

    def _weight(self, sums: np.ndarray) -> float:
        g, h = sums
        return float(-g / (h + self.l2) * self.rate) if h + self.l2 > 0 else 0.0

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to learn from")
        width = len(first.x)
        edges = quantile_edges(rows, width, self.bins)
        table = materialize(binned_rows(rows, edges), "boost_rows")
        base = float(np.log(self.base_score / (1 - self.base_score)))
        table = table.withColumn("margin", F.lit(base))
        weight = table.agg(F.sum("w")).first()[0]
        step = 2.0 ** -min(40, 62 - weight.bit_length())
        depth = 2 + max(len(e) for e in edges)
        trees: list[Tree] = []
        while len(trees) < self.rounds:
            if trees:
                table = materialize(with_margins(table, trees[-ROUNDS_A_TABLE:], width), "boost_margins")
            trees += self._more_trees(table, min(ROUNDS_A_TABLE, self.rounds - len(trees)), width, depth, step)
        made = BoostedTreesModel(json.dumps({"edges": edges, "base": base, "trees": trees}))
        return made._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


def with_margins(table: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The table with the trees' weights added to its margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = margins(trees, _bins_of(batch.column(0), width), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total)], names=["bins", "y", "w", "margin"])

    return table.select("bins", "y", "w", "margin").mapInArrow(run, "bins binary, y int, w bigint, margin double")


class BoostedTreesModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; adds ``probability_1`` and the prediction. Saved and loaded with the pipeline they stand in."""

    fitted = Param(Params._dummy(), "fitted", "edges, base margin and trees as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, fitted: str | None = None):
        super().__init__()
        if fitted is not None:
            self._set(fitted=fitted)

    def content(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))

    @property
    def featureImportances(self) -> DenseVector:
        """The mean gain of each feature's splits, as shares of one."""
        made = self.content()
        gain, splits = np.zeros(len(made["edges"])), np.zeros(len(made["edges"]))
        for tree in made["trees"]:
            for feature, value in zip(tree["feature"], tree["gain"], strict=True):
                if feature != LEAF:
                    gain[feature] += value
                    splits[feature] += 1
        mean = gain / np.maximum(splits, 1)
        return Vectors.dense(mean / (mean.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made = self.content()
        edges, base, trees = made["edges"], made["base"], made["trees"]

        @F.arrow_udf("double")
        def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = KnownMargins(trees, base)
            for x in batches:
                yield pa.array(1 / (1 + np.exp(-known.of(to_bins(_matrix(x, len(edges)), edges)))))

        scored = dataset.withColumn("probability_1", probability(vector_to_array(self.getFeaturesCol())))
        return scored.withColumn(self.getPredictionCol(), (F.col("probability_1") > 0.5).cast("double"))
