"""Gradient-boosted trees: trained by Spark ML on a bounded sample, applied in tasks as plain arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ensemble:
    """Trees as arrays with one row per tree. A leaf is its own left and right child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray
    depth: int
    constant: float | None = None

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """P(label = 1) of each row of features."""
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        margin, every = np.zeros(len(rows)), np.arange(len(rows))
        for t, weight in enumerate(self.weights):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                low = rows[every, self.feature[t, at]] <= self.threshold[t, at]
                at = np.where(low, self.left[t, at], self.right[t, at])
            margin += weight * self.value[t, at]
        return 1 / (1 + np.exp(-2 * margin))


def constant(value: float) -> Ensemble:
    none = np.zeros((0, 1))
    return Ensemble(none, none, none, none, none, np.zeros(0), 0, value)


def _nodes(root) -> list[tuple[int, float, int, int, float]]:
    """(feature, threshold, left, right, value) of each node, the root first."""
    out: list[tuple[int, float, int, int, float]] = []

    def add(node) -> int:
        number = len(out)
        out.append((0, 0.0, number, number, node.prediction()))
        if node.subtreeDepth() > 0:
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            out[number] = (split.featureIndex(), split.threshold(), left, right, node.prediction())
        return number

    add(root)
    return out


def fit(rows: DataFrame, iterations: int = 20, depth: int = 4, step: float = 0.2) -> Ensemble:
    """Train on `features` (array<double>) and `label` (0.0 or 1.0). With one label only, or no rows, a constant.

    `rows` must be stored and bounded: training passes over them many times.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return constant(next(iter(counts), 0.0))
    data = rows.select(array_to_vector("features").alias("features"), "label")
    model = GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=step, maxBins=64, seed=7).fit(data)
    trees = [_nodes(tree._java_obj.rootNode()) for tree in model.trees]
    size = max(map(len, trees))
    table = np.zeros((5, len(trees), size))
    for t, nodes in enumerate(trees):
        table[:, t, : len(nodes)] = np.array(nodes).T
    whole = table[[0, 2, 3]].astype(np.int64)
    return Ensemble(whole[0], table[1], whole[1], whole[2], table[4], np.array(model.treeWeights), depth)


def calibrate(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic calibration of `score` against `label`: the knots of a non-decreasing, piecewise linear function."""
    if rows.isEmpty():
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    model = IsotonicRegression(featuresCol="score", labelCol="label").fit(rows.select(F.col("score"), F.col("label")))
    return np.array(model.boundaries.toArray()), np.array(model.predictions.toArray())
