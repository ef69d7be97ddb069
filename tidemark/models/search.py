"""Seeded random search that maximises the validation AUC."""

from __future__ import annotations

import math
import random
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame

from tidemark.models.learners import positive_weight, train_boosted, with_probability
from tidemark.operators.evaluate import roc_auc
from tidemark.sources import config

SEARCH_ROUNDS = 500
# Ranges as (low, high, kind), or a value that every trial has.
SPACE_A = {
    "max_leaves": (15, 127, "int"),
    "rate": (0.01, 0.2, "log"),
    "feature_share": (0.5, 1.0, "float"),
    "row_share": (0.5, 1.0, "float"),
    "row_every": 5,
    "min_rows": (5, 100, "int"),
    "l1": (0.0, 1.0, "float"),
    "l2": (0.0, 1.0, "float"),
}
SPACE_B = {
    "max_leaves": 0,
    "max_depth": (3, 12, "int"),
    "rate": (0.01, 0.2, "log"),
    "row_share": (0.5, 1.0, "float"),
    "feature_share": (0.5, 1.0, "float"),
    "min_hessian": (1, 5, "int"),
    "l1": (0.0, 1.0, "float"),
    "l2": (0.0, 1.0, "float"),
}


def draw(space: dict[str, object], rng: random.Random) -> dict:
    """One point of the space."""
    point = {}
    for name, wanted in space.items():
        if not isinstance(wanted, tuple):
            point[name] = wanted
            continue
        low, high, kind = wanted
        if kind == "int":
            point[name] = rng.randint(low, high)
        elif kind == "log":
            point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        else:
            point[name] = rng.uniform(low, high)
    return point


def random_search(
    train: DataFrame,
    validation: DataFrame,
    space: dict[str, object],
    trials: int = config.SEARCH_TRIALS,
    rounds: int = SEARCH_ROUNDS,
    seed: int = config.SEED,
    at_once: int = 2,
) -> tuple[dict, list[tuple[dict, float]]]:
    """Best parameters and all trials with their AUC. Trials are Spark jobs; a few run side by side."""
    rng = random.Random(seed)
    points = [draw(space, rng) for _ in range(trials)]
    weight = positive_weight(train)

    def run(point: dict) -> tuple[dict, float]:
        model = train_boosted(train, validation, point, rounds, weight=weight)
        auc = roc_auc(with_probability(model, validation, "score"), []).first()["roc_auc"]
        return point, -1.0 if auc is None else float(auc)

    with ThreadPool(at_once) as pool:
        results = pool.map(run, points)
    best = max(range(trials), key=lambda i: (results[i][1], -i))
    return results[best][0], results
