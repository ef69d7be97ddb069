"""Additive attribution of boosted trees: exact path-dependent Shapley values for every row.

The trees are a broadcast variable, bounded by rounds times nodes of a tree; rows stay where they are and keep
their key, so a contribution is found by key and never by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.boosting import Boosted, Tree

# A leaf: its value and, per feature on its path, the interval (low, high] and the share of training rows that
# would go this way if the feature were unknown.
Leaf = tuple[float, list[tuple[int, float, float, float]]]


def leaf_paths(tree: Tree) -> list[Leaf]:
    """All leaves of a tree; a feature met twice on a path is one entry."""
    leaves: list[Leaf] = []
    todo: list[tuple[int, dict]] = [(0, {})]
    while todo:
        node, bounds = todo.pop()
        feature = int(tree.feature[node])
        if feature < 0:
            leaves.append((float(tree.value[node]), [(f, *interval) for f, interval in bounds.items()]))
            continue
        threshold = float(tree.threshold[node])
        low, high, share = bounds.get(feature, (-np.inf, np.inf, 1.0))
        for child, interval in (
            (int(tree.left[node]), (low, min(high, threshold))),
            (int(tree.right[node]), (max(low, threshold), high)),
        ):
            ratio = tree.cover[child] / tree.cover[node]
            todo.append((child, {**bounds, feature: (*interval, share * ratio)}))
    return leaves


def shapley(matrix: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Contribution of every feature for every row of the matrix.

    For one leaf, a coalition knows some features of the path: known ones are met or not by the row, unknown ones
    pass with their training share. The weight of a coalition of k among d features is the integral of
    t^k (1 - t)^(d - 1 - k), so the sum over all coalitions is the integral of the product of
    (t * met + (1 - t) * share) over the other features. Gauss-Legendre points make it exact, and the product of
    the whole path is formed once and divided by each feature's own factor, which is above 0.
    """
    result = np.zeros_like(matrix)
    for value, path in leaves:
        d = len(path)
        if d == 0 or value == 0.0:
            continue
        points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        # A value without order went right, past every threshold.
        met = np.stack([~(matrix[:, f] <= low) & ((matrix[:, f] <= high) | (high == np.inf)) for f, low, high, _ in path])
        share = np.array([s for *_, s in path])[:, None]
        sums = np.zeros(met.shape)
        for t, weight in zip(points, weights):
            factors = t * met + (1 - t) * share
            sums += weight * factors.prod(axis=0) / factors
        result[:, [f for f, *_ in path]] += (value * (met - share) * sums).T
    return result


def explain(model: Boosted, df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Long table (keys, base_value, feature, value, contribution) of the margin, one row per feature."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def attribute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        leaves = [leaf for tree in shared.value.trees for leaf in leaf_paths(tree)]
        for values in batches:
            if not len(values):
                yield pd.Series([], dtype=object)
                continue
            yield pd.Series(list(shapley(np.stack(values.to_numpy()).astype("float64"), leaves)))

    named = F.arrays_zip(
        F.array(*[F.lit(f) for f in features]).alias("feature"),
        F.col("_values").alias("value"),
        F.col("_parts").alias("contribution"),
    )
    rows = df.select(*keys, vector_to_array("features").alias("_values"))
    explained = rows.withColumn("_parts", attribute("_values"))
    return explained.select(*keys, F.lit(model.expected()).alias("base_value"), F.inline(named))


def importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def combined_importance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Average of two importance tables on the features both have."""
    right = b.select("feature", F.col("importance").alias("_other"))
    return a.join(right, on="feature").select("feature", ((F.col("importance") + F.col("_other")) / 2).alias("importance"))


def mean_contributions(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the contributions of two models per row and feature."""
    right = b.select(*keys, "feature", F.col("contribution").alias("_other"))
    joined = a.join(right, on=[*keys, "feature"])
    mean = (F.col("contribution") + F.col("_other")) / 2
    return joined.select(*keys, "feature", "value", mean.alias("contribution"))


def top_contributions(contributions: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The n largest contributions of each row by absolute value."""
    from tidemark.operators.explore import top_per_group

    return top_per_group(contributions, keys, [F.abs("contribution").desc(), F.col("feature").asc()], n)


def generate_explanations(
    model_a, model_b, df: DataFrame, keys: list[str], features: list[str]
) -> dict[str, DataFrame]:
    """Contributions of both models to every row and the combined importance."""
    first, second = (explain(m, df, keys, features) for m in (model_a, model_b))
    return {
        "contributions_a": first,
        "contributions_b": second,
        "importance_a": importance(first),
        "importance_b": importance(second),
        "importance": combined_importance(importance(first), importance(second)),
    }
