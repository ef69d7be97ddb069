"""Gradient boosted trees on binned features, grown from distributed sums and able to go on.

Rows become bytes once: the number of the bin of every feature. A pass over them adds up gradients and second
derivatives per (node, feature, bin) in each task, Spark brings the sums of a feature together and finds its best
cut, and the driver sees a few numbers per node. Sums are whole numbers (fixed point), so they do not depend on
the order of tasks, and a pass that is repeated after a loss finds the same tree.

The margin of every row is written with the rows each ``BLOCK`` trees; between two writes a task adds the few trees
since. Growing on is therefore as cheap as starting, and the validation AUC of every round is taken from the
same table.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.evaluate import roc_auc
from tidemark.shared import keep
from tidemark.sources import config
from tidemark.sources.tables import read_report, write_report

BINS = 256
BLOCK = 25
#: Sums are kept in units of 2^-24, exact for 5 * 10^11 rows of weight 1.
UNIT = float(2**24)
#: Bytes of sums a task may hold; more nodes are taken in further passes.
SUM_BYTES = 2**26


@dataclass(frozen=True)
class Shape:
    """How trees are grown. ``max_leaves`` 0 and ``max_depth`` 0 mean no limit; one of them must be set."""

    max_leaves: int = 31
    max_depth: int = 0
    rate: float = 0.05
    l1: float = 0.0
    l2: float = 0.0
    min_rows: int = 1
    min_hessian: float = 1e-3
    row_share: float = 1.0
    row_every: int = 1
    feature_share: float = 1.0


@dataclass
class Tree:
    """Nodes in flat arrays, the root first; a leaf has feature -1. Rows with a value up to the threshold go left."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaves(self, matrix: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Number of the leaf of every row; ``cuts`` are the thresholds, or the bins where the matrix holds bins."""
        at = np.zeros(len(matrix), dtype=np.int64)
        inner = np.flatnonzero(self.feature[at] >= 0)
        while len(inner):
            node = at[inner]
            goes_left = matrix[inner, self.feature[node]] <= cuts[node]
            at[inner] = np.where(goes_left, self.left[node], self.right[node])
            inner = inner[self.feature[at[inner]] >= 0]
        return at

    @property
    def depth(self) -> int:
        level = np.zeros(len(self.feature), dtype=np.int64)
        for node in np.flatnonzero(self.feature >= 0):  # children come after their parent
            level[self.left[node]] = level[self.right[node]] = level[node] + 1
        return int(level.max())


TREE_SCHEMA = (
    "tree int, node int, feature int, cut int, threshold double, left int, right int, value double, cover double"
)


@dataclass
class Boosted:
    """Trees and the margin they start from. All of it is bounded by rounds times nodes of a tree."""

    start: float
    width: int
    trees: list[Tree] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)

    def margins(self, matrix: np.ndarray) -> np.ndarray:
        total = np.full(len(matrix), self.start)
        for tree in self.trees:
            total += tree.value[tree.leaves(matrix, tree.threshold)]
        return total

    def expected(self) -> float:
        """Margin of a row of which nothing is known: leaves by their share of the training rows."""
        leaf = [(t.value * t.cover)[t.feature < 0].sum() / t.cover[0] for t in self.trees]
        return self.start + float(sum(leaf))

    def transform(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """Rows with their margin, by the trees as a broadcast variable."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in batches:
                matrix = np.stack(values.to_numpy()) if len(values) else np.zeros((0, shared.value.width))
                yield pd.Series(shared.value.margins(matrix.astype("float64")))

        return df.withColumn(name, margin(vector_to_array("features")))

    def with_probability(self, df: DataFrame, name: str) -> DataFrame:
        rows = self.transform(df, "_margin")
        return rows.withColumn(name, 1 / (1 + F.exp(-F.col("_margin")))).drop("_margin")

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node."""
        parts = [
            pd.DataFrame({"tree": i, "node": np.arange(len(t.feature)), **vars(t)}) for i, t in enumerate(self.trees)
        ]
        if not parts:
            return spark.createDataFrame([], TREE_SCHEMA)
        rows = pd.concat(parts)[[c.split()[0] for c in TREE_SCHEMA.split(", ")]]
        return spark.createDataFrame(rows, TREE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        write_report(spark, {"start": self.start, "width": self.width, "scores": self.scores}, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        about = read_report(spark, f"{path}/model")
        nodes = spark.read.schema(TREE_SCHEMA).parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        trees = [
            Tree(**{c: part[c].to_numpy() for c in Tree.__dataclass_fields__}) for _, part in nodes.groupby("tree")
        ]
        return cls(about["start"], about["width"], trees, about["scores"])


def edges(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Cuts of every feature at its quantiles, at most ``bins`` - 1; the distinct values where they are fewer.

    The quantile summary is exact up to 10,000 rows and within 1/10,000 of the rank beyond.
    """
    values = rows.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
    shares = [i / bins for i in range(1, bins)]
    found = values.groupBy("feature").agg(
        F.percentile_approx("value", shares, F.lit(10000)).alias("cuts"), F.max("value").alias("greatest")
    )
    cuts = [np.empty(0)] * width
    for row in found.collect():  # one row per feature
        distinct = np.unique(np.array(row["cuts"], dtype="float64"))
        # The greatest value needs no cut above it, unless values without order follow.
        cuts[row["feature"]] = distinct[~(distinct >= row["greatest"]) & ~np.isnan(distinct)]
    return cuts


def binned(rows: DataFrame, model: Boosted, cuts: list[np.ndarray], label: str, weight: str) -> DataFrame:
    """Table (row, label, weight, margin, bins) that all passes read, written once, with the margins of ``model``.

    A value without order goes last.
    """

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                matrix = np.stack(batch.pop("_values").to_numpy())
                numbers = np.stack([np.searchsorted(c, matrix[:, i]) for i, c in enumerate(cuts)], 1).astype("uint8")
                yield batch.assign(margin=model.margins(matrix), bins=[r.tobytes() for r in numbers])

    columns = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(label).cast("double").alias("label"),
        F.col(weight).cast("double").alias("weight"),
        vector_to_array("features").alias("_values"),
    )
    schema = "row long, label double, weight double, margin double, bins binary"
    return keep(columns.mapInPandas(assign, schema), "boosting")


def _matrix(bins: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bins), dtype="uint8").reshape(len(bins), width)


def _added(margin: np.ndarray, matrix: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.leaves(matrix, tree.cut)]
    return margin


def advanced(rows: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The table with the margins after more trees, written anew."""

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                margin = _added(batch["margin"].to_numpy(), _matrix(batch["bins"], width), trees)
                yield batch.assign(margin=margin)

    return keep(rows.mapInPandas(advance, rows.schema), "boosting")


def drawn(row: np.ndarray, bag: int, share: float) -> np.ndarray:
    """Whether a row is in a bag: a mix of its number and the bag's, so a repeated task draws alike."""
    mixed = row.astype("uint64") + np.uint64((bag + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    return mixed / float(2**64) < share


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log loss in whole units."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - label) * weight * UNIT), np.rint(p * (1 - p) * weight * UNIT)


CUT_SCHEMA = "node int, gain double, feature int, bin int, nl long, gl long, hl long, n long, g long, h long"


def _strength(total: np.ndarray, hessian: np.ndarray, shape: Shape) -> np.ndarray:
    """What a leaf with these sums takes off the loss, doubled."""
    weight = hessian + shape.l2
    shrunk = np.maximum(np.abs(total) - shape.l1, 0.0)
    return np.divide(shrunk**2, weight, out=np.zeros(len(total)), where=weight > 0)


def best_cuts(sums: DataFrame, shape: Shape) -> DataFrame:
    """Best cut of every node among the features that meet in a task, and the totals of the node.

    ``sums`` holds the packed sums of a task per (node, feature). Equal gains go to the first feature, then the first
    bin. A node without a valid cut has a gain of -1. A task holds the sums of its own (node, feature) only.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for node, feature, packed in batch.itertuples(index=False):
                cells = np.frombuffer(packed, dtype="int64").reshape(3, BINS)
                held[node, feature] = held[node, feature] + cells if (node, feature) in held else cells
        found: dict[int, tuple] = {}
        for (node, feature), cells in sorted(held.items()):
            upto = cells.cumsum(axis=1)
            n, g, h = upto[:, -1]
            nl, gl, hl = upto
            left, right = hl / UNIT, (h - hl) / UNIT
            gain = _strength(gl / UNIT, left, shape) + _strength((g - gl) / UNIT, right, shape)
            gain -= _strength(np.array([g / UNIT]), np.array([h / UNIT]), shape)
            least = max(shape.min_rows, 1)
            valid = (nl >= least) & (n - nl >= least) & (left >= shape.min_hessian) & (right >= shape.min_hessian)
            gain = np.where(valid, gain, -1.0)
            cut = int(gain.argmax())
            if node not in found or gain[cut] > found[node][1]:
                found[node] = (node, gain[cut], feature, cut, nl[cut], gl[cut], hl[cut], n, g, h)
        yield pd.DataFrame(list(found.values()), columns=[c.split()[0] for c in CUT_SCHEMA.split(", ")])

    return sums.repartition("node", "feature").mapInPandas(search, CUT_SCHEMA)


@dataclass
class _Node:
    n: int = 0
    g: int = 0
    h: int = 0
    depth: int = 0
    gain: float | None = None
    feature: int = -1
    cut: int = 0
    left: int = -1
    right: int = -1
    sides: tuple = ()


def _picked(nodes: list[_Node], most: int) -> list[int]:
    """Nodes cut when the greatest gain goes first, as far as gains are known."""
    heap, picks = [(-(nodes[0].gain or -1.0), 0)], []
    while heap and (not most or len(picks) < most - 1):
        loss, number = heapq.heappop(heap)
        if loss >= 0:
            break
        picks.append(number)
        for child in (nodes[number].left, nodes[number].right):
            if child >= 0 and nodes[child].gain is not None:
                heapq.heappush(heap, (-nodes[child].gain, child))
    return picks


def _flat(nodes: list[_Node], picks: set[int], shape: Shape, cuts: list[np.ndarray]) -> tuple[Tree, dict[int, int]]:
    """The tree of the picked nodes, and the new number of every node in it."""
    numbers, todo = {}, [0]
    while todo:
        number = todo.pop(0)
        numbers[number] = len(numbers)
        if number in picks:
            todo += [nodes[number].left, nodes[number].right]
    tree = Tree(*(np.zeros(len(numbers), dtype=t) for t in ("i4", "i4", "f8", "i4", "i4", "f8", "f8")))
    for number, at in numbers.items():
        node, inner = nodes[number], number in picks
        tree.feature[at] = node.feature if inner else -1
        tree.cut[at] = node.cut if inner else 0
        tree.threshold[at] = cuts[node.feature][node.cut] if inner else 0.0
        tree.left[at] = numbers[node.left] if inner else -1
        tree.right[at] = numbers[node.right] if inner else -1
        total, weight = node.g / UNIT, node.h / UNIT + shape.l2
        shrunk = math.copysign(max(abs(total) - shape.l1, 0.0), total)
        tree.value[at] = 0.0 if inner or weight <= 0 else -shape.rate * shrunk / weight
        tree.cover[at] = node.n
    return tree, numbers


def grow(
    rows: DataFrame, recent: list[Tree], cuts: list[np.ndarray], shape: Shape, chosen: list[int], bag: int
) -> Tree:
    """One tree. Gains of a node do not depend on other nodes, so whole frontiers are summed in one pass, and a
    further pass is due only while a picked node has children whose gain is not known."""
    width = len(cuts)
    nodes = [_Node()]

    def evaluate(waiting: list[int]) -> None:
        tree, numbers = _flat(nodes, {i for i, n in enumerate(nodes) if n.left >= 0}, shape, cuts)
        slots = np.full(len(tree.feature), -1, dtype=np.int64)
        for slot, number in enumerate(waiting):
            slots[numbers[number]] = slot
        held, features = len(waiting), np.array(chosen)

        def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((3, len(features), held * BINS))
            for batch in batches:
                matrix = _matrix(batch["bins"], width)
                slot = slots[tree.leaves(matrix, tree.cut)]
                used = slot >= 0
                if shape.row_share < 1:
                    used &= drawn(batch["row"].to_numpy(), bag, shape.row_share)
                if not used.any():
                    continue
                matrix, slot, batch = matrix[used], slot[used], batch[used]
                g, h = gradients(_added(batch["margin"].to_numpy(), matrix, recent), batch["label"].to_numpy(), batch["weight"].to_numpy())
                for i, f in enumerate(features):
                    cell = slot * BINS + matrix[:, f]
                    for k, amount in enumerate((None, g, h)):
                        sums[k, i] += np.bincount(cell, amount, held * BINS)
            packed = sums.astype("int64").reshape(3, len(features), held, BINS)
            some = [(i, slot) for i in range(len(features)) for slot in range(held) if packed[0, i, slot].any()]
            yield pd.DataFrame(
                [(waiting[slot], features[i], packed[:, i, slot].tobytes()) for i, slot in some],
                columns=["node", "feature", "sums"],
            )

        found = best_cuts(rows.mapInPandas(tally, "node int, feature int, sums binary"), shape).collect()
        # A row per node and task of the search at most; the last one written is the best.
        for row in sorted(found, key=lambda r: (r["gain"], -r["feature"])):
            node = nodes[row["node"]]
            node.n, node.g, node.h = row["n"], row["g"], row["h"]
            node.gain, node.feature, node.cut = row["gain"], row["feature"], row["bin"]
            left = (row["nl"], row["gl"], row["hl"])
            node.sides = (left, tuple(a - b for a, b in zip((node.n, node.g, node.h), left)))
        for number in waiting:
            nodes[number].gain = -1.0 if nodes[number].gain is None else nodes[number].gain

    together = max(1, SUM_BYTES // (24 * BINS * len(chosen)))
    waiting = [0]
    while waiting:
        for start in range(0, len(waiting), together):
            evaluate(waiting[start:start + together])
        picks = _picked(nodes, shape.max_leaves)
        for number in picks:
            node = nodes[number]
            if node.left < 0:
                node.left, node.right = len(nodes), len(nodes) + 1
                for side in node.sides:
                    small = side[0] < 2 * max(shape.min_rows, 1)
                    deepest = shape.max_depth and node.depth + 1 >= shape.max_depth
                    nodes.append(_Node(*side, node.depth + 1, -1.0 if small or deepest else None))
        waiting = [c for p in picks for c in (nodes[p].left, nodes[p].right) if nodes[c].gain is None]
    return _flat(nodes, set(picks), shape, cuts)[0]


def watched(rows: DataFrame, trees: list[Tree], width: int) -> list[float]:
    """Validation AUC after each of the trees; 0.5 where a class is missing."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            margin, matrix = batch["margin"].to_numpy(), _matrix(batch["bins"], width)
            for i, tree in enumerate(trees):
                margin = _added(margin, matrix, [tree])
                yield pd.DataFrame({"round": i, "label": batch["label"].astype("int32"), "score": margin})

    long = rows.mapInPandas(follow, "round int, label int, score double")
    found = {r["round"]: r["roc_auc"] for r in roc_auc(long, ["round"]).collect()}  # one row per round
    return [0.5 if found.get(i) is None else found[i] for i in range(len(trees))]


def best_round(scores: list[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the highest score before ``patience`` rounds in a row bring none higher, and whether that end came."""
    best = 0
    for i, score in enumerate(scores):
        if score > scores[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boost(
    train: DataFrame, validation: DataFrame, shape: Shape, rounds: int, patience: int, label: str = "label",
    weight: str = "weight", model: Boosted | None = None, seed: int = config.SEED,
) -> Boosted:
    """Trees until ``patience`` rounds bring no higher validation AUC, cut at the best round.

    With ``model`` its trees are kept and new ones added. Without validation rows of both classes every round scores
    0.5, so the first one stays. The margin starts at the log odds of the weighted labels.
    """
    if not (shape.max_leaves or shape.max_depth):
        raise ValueError("a shape needs max_leaves or max_depth")
    totals = train.agg(
        F.sum(F.col(weight) * F.col(label)).alias("pos"), F.sum(weight).alias("all"),
        F.first(F.size(vector_to_array("features"))).alias("width"),
    ).first()
    if not totals["width"]:
        raise ValueError("no rows or no features to train on")
    if model is None:
        share = min(max(totals["pos"] / totals["all"], 1e-6), 1 - 1e-6)
        model = Boosted(math.log(share / (1 - share)), totals["width"])
    cuts = edges(train, model.width)

    rows, held_out = (binned(side, model, cuts, label, weight) for side in (train, validation))
    trees, scores = list(model.trees), list(model.scores)
    first = len(trees)
    while len(trees) < first + rounds:
        block: list[Tree] = []
        for _ in range(min(BLOCK, first + rounds - len(trees))):
            number = len(trees) + len(block)
            rng = random.Random(f"{seed} {number}")
            chosen = sorted(rng.sample(range(model.width), max(1, round(shape.feature_share * model.width))))
            block.append(grow(rows, block, cuts, shape, chosen, seed + number // shape.row_every))
        scores += watched(held_out, block, model.width)
        trees += block
        best, ended = best_round(scores, patience)
        if ended:
            break
        if len(trees) < first + rounds:
            rows, held_out = advanced(rows, block, model.width), advanced(held_out, block, model.width)
    best, _ = best_round(scores, patience)
    return replace(model, trees=trees[:best], scores=scores[:best])
