"""From folds to models, predictions, metrics and explanations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models import search
from tidemark.models.attribution import generate_explanations
from tidemark.models.learners import (
    ROUNDS,
    SHAPE_A,
    SHAPE_B,
    Calibrator,
    Inputs,
    feature_columns,
    train_baseline,
    train_boosted,
    with_probability,
)
from tidemark.operators.evaluate import blend, fold_summary, metric_table
from tidemark.shared import keep
from tidemark.sources import config
from tidemark.sources.tables import read_report, write_csv, write_json, write_report, write_table

TRIALS_SCHEMA = "model string, trial int, parameters string, auc double, chosen boolean"
SCORES = {"a": "prob_a", "b": "prob_b", "ensemble": "prob_ensemble", "calibrated": "prob_calibrated"}


def load_fold(folds: DataFrame, fold: int, features: list[str] | None = None) -> tuple[Inputs, dict[str, DataFrame]]:
    """Inputs fitted on the training rows, and each split with its vectors."""
    rows = folds.where(F.col("fold") == fold)
    names = features or feature_columns(folds.drop("fold", "split"))
    inputs = Inputs.fit(rows.where("split = 'train'"), names)
    ready = keep(inputs.transform(rows), "fold")
    return inputs, {split: ready.where(F.col("split") == split) for split in ("train", "val", "test")}


def score_rows(model_a, model_b, rows: DataFrame, weights: tuple[float, float] = config.BLEND_WEIGHTS) -> DataFrame:
    """Probabilities of both models and their blend."""
    scored = with_probability(model_b, with_probability(model_a, rows, "prob_a"), "prob_b")
    return scored.withColumn("prob_ensemble", blend(F.col("prob_a"), F.col("prob_b"), weights))


def evaluate_fold(
    model_a, model_b, splits: dict[str, DataFrame], meta: list[str], tie: str, method: str = "platt",
    ks: list[int] | None = None,
) -> tuple[DataFrame, DataFrame, Calibrator]:
    """Test predictions, metrics of the four scores as (model, metric, value), and the calibrator."""
    validation = keep(score_rows(model_a, model_b, splits["val"]).select("label", "prob_ensemble"), "validation")
    calibrator = Calibrator.fit(validation, "prob_ensemble", method)
    tested = calibrator.transform(score_rows(model_a, model_b, splits["test"]), "prob_ensemble", "prob_calibrated")
    predictions = keep(tested.select(*dict.fromkeys([*meta, "label", *SCORES.values()])), "predictions")
    cases = F.array(
        *[F.struct(F.lit(name).alias("model"), F.col(column).alias("score")) for name, column in SCORES.items()]
    )
    long = predictions.select("label", F.xxhash64(tie).alias("_tie"), F.inline(cases))
    return predictions, metric_table(long, ["model"], "_tie", ks), calibrator


def _trial_rows(model: str, best: dict, trials: list[tuple[dict, float]]) -> list[tuple]:
    """Rows of one search; of equal points the first is the chosen one."""
    chosen = next(i for i, (point, _) in enumerate(trials) if point is best)
    return [(model, i, json.dumps(point, sort_keys=True), auc, i == chosen) for i, (point, auc) in enumerate(trials)]


def saved_shapes(spark: SparkSession, out: str) -> dict[str, dict]:
    """Shapes of the two learners as ``train`` saved them."""
    return read_report(spark, f"{out}/shapes")


def train(
    folds: DataFrame,
    meta: list[str],
    tie: str = "player_id",
    out: str | None = None,
    numbers: list[int] | None = None,
    features: list[str] | None = None,
    trials: int = config.SEARCH_TRIALS,
    rounds: int = ROUNDS,
    method: str = "platt",
    search_rounds: int = search.SEARCH_ROUNDS,
    shapes: dict[str, dict] | None = None,
) -> dict[str, object]:
    """Tune on the first fold unless ``shapes`` are given, then fit, evaluate and explain every fold.

    A trial of the search takes at most ``search_rounds`` rounds, and no more than a training. The shapes used come
    back as ``shapes`` and the trials behind them as ``trials`` (model, trial, parameters, auc, chosen); with
    ``out`` both are saved, and ``saved_shapes`` reads the shapes for a later training.
    """
    numbers = numbers or [n for n, *_ in config.FOLDS]
    shape_a, shape_b = (shapes["a"], shapes["b"]) if shapes else (SHAPE_A, SHAPE_B)
    baseline, last = None, {}
    tried: list[tuple] = []
    predictions, metrics, importance = [], [], []
    for n in numbers:
        inputs, splits = load_fold(folds, n, features)
        if n == numbers[0]:
            baseline = train_baseline(splits["train"])
            if trials and shapes is None:
                at_most = min(rounds, search_rounds)
                shape_a, trials_a = search.random_search(splits["train"], splits["val"], search.SPACE_A, trials, at_most)
                shape_b, trials_b = search.random_search(splits["train"], splits["val"], search.SPACE_B, trials, at_most)
                tried = [*_trial_rows("a", shape_a, trials_a), *_trial_rows("b", shape_b, trials_b)]
        model_a = train_boosted(splits["train"], splits["val"], shape_a, rounds)
        model_b = train_boosted(splits["train"], splits["val"], shape_b, rounds)
        scored, measured, calibrator = evaluate_fold(model_a, model_b, splits, meta, tie, method)
        explained = generate_explanations(model_a, model_b, splits["test"], meta, inputs.features)
        predictions.append(scored.withColumn("fold", F.lit(n)))
        metrics.append(keep(measured.withColumn("fold", F.lit(n)), "metrics"))
        importance.append(keep(explained["importance"].withColumn("fold", F.lit(n)), "importance"))
        if out:
            model_a.save(folds.sparkSession, f"{out}/fold_{n}/model_a")
            model_b.save(folds.sparkSession, f"{out}/fold_{n}/model_b")
            calibrator.save(f"{out}/fold_{n}/calibrator")
            write_report(folds.sparkSession, {**inputs.as_report(), "method": method}, f"{out}/fold_{n}/inputs")
            write_table(explained["contributions_a"], f"{out}/fold_{n}/contributions_a")
            write_table(explained["contributions_b"], f"{out}/fold_{n}/contributions_b")
        last = {"inputs": inputs, "model_a": model_a, "model_b": model_b, "calibrator": calibrator}

    def stacked(frames: list[DataFrame]) -> DataFrame:
        result = frames[0]
        for frame in frames[1:]:
            result = result.unionByName(frame)
        return result

    every = stacked(importance).groupBy("feature").agg(F.avg("importance").alias("importance"))
    results = {
        "predictions": stacked(predictions),
        "metrics": stacked(metrics),
        "summary": fold_summary(stacked(metrics), ["model"]),
        "importance": every,
        "baseline": baseline,
        "shapes": {"a": shape_a, "b": shape_b},
        "trials": folds.sparkSession.createDataFrame(tried, TRIALS_SCHEMA),
        **last,
    }
    if out:
        if baseline is not None:
            baseline.write().overwrite().save(f"{out}/baseline")
        write_csv(results["predictions"], f"{out}/predictions")
        write_csv(every.orderBy(F.col("importance").desc(), "feature"), f"{out}/importance")
        write_report(folds.sparkSession, results["shapes"], f"{out}/shapes")
        write_table(results["trials"], f"{out}/trials")
        write_json(results["metrics"], f"{out}/metrics")
        write_json(results["summary"], f"{out}/summary")
    return results
