"""Learners and calibration on Spark ML.

The two boosted learners are one grower of trees (``boosting``) in the shapes of the two native libraries the
original uses: one by greatest gain up to a number of leaves, one by level. Fitted numbers differ a little.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.models import boosting
from tidemark.operators.clean import numeric_columns
from tidemark.operators.select import align, apply_medians, fit_medians
from tidemark.sources import config

ROUNDS = 1000
PATIENCE = 50
# Shapes of the two boosted learners, with the defaults of the native libraries where they set none.
SHAPE_A = {
    "max_leaves": 31, "rate": 0.05, "row_share": 0.8, "row_every": 5, "feature_share": 0.8, "min_rows": 20,
}
SHAPE_B = {
    "max_leaves": 0, "max_depth": 6, "rate": 0.05, "row_share": 0.8, "feature_share": 0.8, "l2": 1.0, "min_hessian": 1.0,
}

# Model inputs may include the age, which pruning protects.
NEVER_INPUTS = [c for c in config.PROTECTED if c != "age"]


def feature_columns(df: DataFrame, never: list[str] | None = None) -> list[str]:
    """Sorted numeric columns outside the protected set."""
    return sorted(numeric_columns(df, never or NEVER_INPUTS))


def class_weights(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Negatives per positive, NULL without positives."""
    return df.groupBy(*keys).agg(
        F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("weight")
    )


def positive_weight(train: DataFrame, setting: float | str = "auto", label: str = "label") -> float:
    """Fixed weight of positives, or negatives per positive of the training rows (1 without positives)."""
    if setting != "auto":
        return float(setting)
    weight = class_weights(train, [], label).first()["weight"]
    return 1.0 if weight is None else float(weight)


def weighted(df: DataFrame, weight: float, label: str = "label") -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)))


@dataclass
class Inputs:
    """Feature list and medians of the training rows; turns rows into vectors, also new ones."""

    features: list[str]
    medians: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, features: list[str]) -> Inputs:
        return cls(features, fit_medians(train, features))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``: listed columns in order, gaps filled, columns that are absent 0.0."""
        others = [c for c in df.columns if c not in self.features]
        aligned = apply_medians(align(df, self.features, others), self.medians)
        vectors = VectorAssembler(inputCols=self.features, outputCol="features").transform(aligned)
        return vectors.select(*[c for c in df.columns], "features") if set(self.features) <= set(df.columns) else vectors


    def as_report(self) -> dict:
        return {"features": self.features, "medians": self.medians}


def probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def train_baseline(train: DataFrame, c: float = 1.0, max_iter: int = 1000, label: str = "label") -> PipelineModel:
    """Standardised logistic regression with balanced classes and an L2 penalty of strength 1 / C."""
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    n, p = counts["n"], counts["p"]
    balanced = train.withColumn(
        "weight", F.when(F.col(label) == 1, F.lit(n / (2.0 * p))).otherwise(F.lit(n / (2.0 * (n - p))))
    )
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(balanced)
    learner = LogisticRegression(
        featuresCol="scaled",
        labelCol=label,
        weightCol="weight",
        regParam=1.0 / (c * n),
        standardization=False,
        maxIter=max_iter,
    )
    return PipelineModel([scaler, learner.fit(scaler.transform(balanced))])


def train_boosted(
    train: DataFrame,
    validation: DataFrame,
    shape: dict | None = None,
    rounds: int = ROUNDS,
    label: str = "label",
    weight: float | None = None,
    patience: int = PATIENCE,
    model: boosting.Boosted | None = None,
) -> boosting.Boosted:
    """Boosted trees with class weight, cut at the round with the highest validation AUC.

    A given ``model`` is continued. ``shape`` holds fields of ``boosting.Shape``.
    """
    weight = positive_weight(train, label=label) if weight is None else weight
    rows = weighted(train.select("features", label), weight, label)
    held_out = weighted(validation.select("features", label), weight, label)
    return boosting.boost(rows, held_out, boosting.Shape(**(shape or SHAPE_A)), rounds, patience, label, model=model)


class Calibrator:
    """Maps a score to a probability, fitted on validation rows."""

    def __init__(self, method: str, model):
        self.method, self.model = method, model

    @classmethod
    def fit(cls, df: DataFrame, score: str, method: str = "platt", label: str = "label") -> Calibrator:
        if method == "isotonic":
            # One weighted row per distinct score is all the fit depends on.
            points = df.groupBy(F.col(score).alias("_score")).agg(
                F.avg(label).alias("_label"), F.count(F.lit(1)).cast("double").alias("_weight")
            )
            learner = IsotonicRegression(featuresCol="_score", labelCol="_label", weightCol="_weight")
            return cls(method, learner.fit(points))
        points = df.groupBy(F.col(score).alias("_score"), F.col(label).cast("double").alias("_label")).agg(
            F.count(F.lit(1)).cast("double").alias("_weight")
        )
        n = df.count()
        vectors = VectorAssembler(inputCols=["_score"], outputCol="_vector").transform(points)
        learner = LogisticRegression(
            featuresCol="_vector", labelCol="_label", weightCol="_weight", regParam=1.0 / n, standardization=False,
            maxIter=1000,
        )
        return cls(method, learner.fit(vectors))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/{self.method}")

    @classmethod
    def load(cls, path: str, method: str) -> Calibrator:
        kind = IsotonicRegressionModel if method == "isotonic" else LogisticRegressionModel
        return cls(method, kind.load(f"{path}/{method}"))

    def transform(self, df: DataFrame, score: str, name: str) -> DataFrame:
        columns = [c for c in df.columns if c != name]
        if self.method == "isotonic":
            self.model.setFeaturesCol("_score").setPredictionCol("_raw")
            scored = self.model.transform(df.withColumn("_score", F.col(score)))
            raw = F.col("_raw")
        else:
            weight, intercept = float(self.model.coefficients[0]), float(self.model.intercept)
            scored = df
            raw = 1 / (1 + F.exp(-(F.col(score) * F.lit(weight) + F.lit(intercept))))
        return scored.withColumn(name, F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))).select(*columns, name)


def with_probability(model, df: DataFrame, name: str) -> DataFrame:
    """Rows with the probability of class 1 under the model."""
    if isinstance(model, boosting.Boosted):
        return model.with_probability(df.drop(name), name)
    return model.transform(df).select(*[c for c in df.columns if c != name], probability().alias(name))
