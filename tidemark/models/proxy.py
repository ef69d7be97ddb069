"""Regression that stands in for a measure only some rows have."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import all_of, clip, ratio
from tidemark.operators.features import one_hot
from tidemark.sources import config

# Inputs, group flags, limits and shape of the proxy model.
PROXY_INPUTS = ["shots_per90", "shots_on_target_per90", "shots_on_target_pct", "goals_per_shot_on_target"]
PROXY_FLAGS = {"pos_FW": "FW", "pos_MF": "MF", "pos_DF": "DF"}
LEAST_INPUTS, LEAST_ROWS, LEAST_TRAIN, LEAST_VALIDATION = 2, 50, 30, 10
SPLIT_PERIOD = "2020"
HIGHEST = 2.0
SHAPE = {"maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 10}
ROUNDS = 200


def add_shot_ratios(df: DataFrame) -> DataFrame:
    """The two shot ratios where the source lacks them."""
    added = {}
    if "shots_on_target_pct" not in df.columns and {"shots_on_target", "shots"} <= set(df.columns):
        added["shots_on_target_pct"] = ratio(F.col("shots_on_target"), F.col("shots")) * 100
    if "goals_per_shot_on_target" not in df.columns and {"goals", "shots_on_target"} <= set(df.columns):
        added["goals_per_shot_on_target"] = ratio(F.col("goals"), F.col("shots_on_target"))
    return df.withColumns(added) if added else df


def proxy_features(
    df: DataFrame, inputs: list[str] | None = None, group: str = "position_group", flags: dict[str, str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Rows with group flags, and the names of the inputs at hand; no names if too few."""
    present = [c for c in (inputs or PROXY_INPUTS) if c in df.columns]
    if len(present) < LEAST_INPUTS:
        return df, []
    if group not in df.columns:
        return df, present
    flags = flags or PROXY_FLAGS
    return one_hot(df, group, flags), [*present, *flags]


def vectors(df: DataFrame, names: list[str]) -> DataFrame:
    """Complete rows with their feature vector."""
    complete = df.where(all_of([F.col(c).isNotNull() for c in names]))
    return VectorAssembler(inputCols=names, outputCol="features").transform(complete)


def proxy_training_rows(
    df: DataFrame, names: list[str], target: str, period: str, keys: list[str], split: str = SPLIT_PERIOD
) -> tuple[DataFrame, DataFrame] | None:
    """Training and validation rows, or None if there are too few.

    Rows before the split period train. If that leaves too few on either side, a hash of the row key
    sends four fifths to training.
    """
    known = vectors(df.where(F.col(target).isNotNull()), names)
    early = F.col(period).cast("string") < split
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(early).alias("early")).first()
    if counts["n"] < LEAST_ROWS:
        return None
    if counts["early"] < LEAST_TRAIN or counts["n"] - counts["early"] < LEAST_VALIDATION:
        early = F.pmod(F.xxhash64(F.lit(config.SEED), *keys), F.lit(100)) < 80
    return known.where(early), known.where(~early)


def train_proxy(train: DataFrame, validation: DataFrame, target: str, rounds: int = ROUNDS, shape: dict | None = None):
    """Boosted regression and its validation figures."""
    learner = GBTRegressor(labelCol=target, maxIter=rounds, seed=config.SEED, **(shape or SHAPE))
    model = learner.fit(train)
    predicted = model.transform(validation)

    def figure(name: str) -> float:
        return RegressionEvaluator(labelCol=target, metricName=name).evaluate(predicted)

    pairs = VectorAssembler(inputCols=[target, "prediction"], outputCol="_pair").transform(
        predicted.select(F.col(target).cast("double").alias(target), "prediction")
    )
    rank = Correlation.corr(pairs, "_pair", "spearman").first()[0].toArray()[0, 1]
    return model, {"r2": figure("r2"), "rmse": figure("rmse"), "rank_correlation": float(rank)}


def apply_proxy(
    df: DataFrame, model, names: list[str], actual: str | None = "goals_per90", name: str = "proxy_xg_per90",
    residual: str = "proxy_xg_overperformance",
) -> DataFrame:
    """Prediction for complete rows, clipped to 0 … 2, NULL for the others, and actual minus prediction.

    A feature list that does not fit the model gives NULL everywhere.
    """
    columns = [c for c in df.columns if c not in (name, residual)]
    if model is None or not names or not set(names) <= set(df.columns) or model.numFeatures != len(names):
        scored = df.withColumn(name, F.lit(None).cast("double"))
    else:
        complete = all_of([F.col(c).isNotNull() for c in names])
        filled = df.withColumns({f"_in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
        assembled = VectorAssembler(inputCols=[f"_in_{c}" for c in names], outputCol="features").transform(filled)
        predicted = model.transform(assembled)
        scored = predicted.withColumn(name, F.when(complete, clip(F.col("prediction"), 0.0, HIGHEST)))
    if actual and actual in df.columns:
        return scored.withColumn(residual, F.col(actual) - F.col(name)).select(*columns, name, residual)
    return scored.select(*columns, name)


def proxy_pipeline(
    df: DataFrame, path: str | None, target: str = "us_xg_per90", period: str = "season", keys: list[str] | None = None,
    rounds: int = ROUNDS, train: bool = True,
) -> tuple[DataFrame, dict | None]:
    """Load the model if it is there, else train and save it; then apply it to all rows.

    Without ``train`` nothing is fitted: where no model has been saved, the measure is NULL.
    """
    prepared, names = proxy_features(add_shot_ratios(df))
    figures, model = None, None
    if path:
        try:
            model = GBTRegressionModel.load(path)
        except Exception as missing:  # no model has been saved yet
            if "does not exist" not in str(missing) and "PATH_NOT_FOUND" not in str(missing):
                raise
    if train and model is None and names and target in df.columns:
        sides = proxy_training_rows(prepared, names, target, period, keys or ["player_id", "league", "season"])
        if sides:
            model, figures = train_proxy(*sides, target, rounds)
            if path:
                model.write().overwrite().save(path)
    applied = apply_proxy(prepared, model, names)
    return applied.drop(*[f for f in PROXY_FLAGS if f in applied.columns and f not in df.columns]), figures
