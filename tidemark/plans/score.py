"""Scoring of new rows with fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models.attribution import explain
from tidemark.models.boosting import Boosted
from tidemark.models.learners import Calibrator, Inputs
from tidemark.operators.clean import clean
from tidemark.operators.match import match_sources
from tidemark.plans.process import feature_frame
from tidemark.plans.train import score_rows
from tidemark.shared import keep
from tidemark.sources.tables import read_report, without_nan, write_csv, write_table

# Seasons and leagues that are scored by default.
SEASONS = ["2023-2024", "2024-2025"]
LEAGUES = ["championship", "eredivisie", "primeira-liga", "belgian-pro-league"]


def load_trained(spark: SparkSession, out: str, fold: int = 3) -> dict[str, object]:
    """Inputs, both models and the calibrator that training saved for a fold."""
    folder = f"{out}/fold_{fold}"
    saved = read_report(spark, f"{folder}/inputs")
    return {
        "inputs": Inputs(saved["features"], saved["medians"]),
        "model_a": Boosted.load(spark, f"{folder}/model_a"),
        "model_b": Boosted.load(spark, f"{folder}/model_b"),
        "calibrator": Calibrator.load(f"{folder}/calibrator", saved["method"]),
    }


def prepare(
    counts: DataFrame, market: DataFrame, expected: DataFrame, proxy_path: str | None,
    seasons: list[str] | None = None, leagues: list[str] | None = None,
) -> DataFrame:
    """Cleaned, filtered, matched and engineered rows of the wanted seasons and leagues.

    Outliers are capped over all seasons before the filter, as the caps depend on them.
    """
    counts, market, expected = without_nan(counts), without_nan(market), without_nan(expected)
    wanted = clean(counts).where(F.col("season").isin(seasons or SEASONS) & F.col("league").isin(leagues or LEAGUES))
    enriched = match_sources(keep(wanted, "cleaned"), market, expected)
    return feature_frame(enriched, proxy_path, 0, False, train=False)[0]


def score(
    rows: DataFrame, inputs: Inputs, model_a, model_b, calibrator: Calibrator, meta: list[str], out: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Predictions, best first, and contributions keyed by ``meta``.

    The fitted feature list and medians are reused; features the new rows lack count as 0.
    """
    ready = keep(inputs.transform(rows), "ready")
    scored = calibrator.transform(score_rows(model_a, model_b, ready), "prob_ensemble", "prob_calibrated")
    shown = scored.select(*meta, "prob_a", "prob_b", "prob_ensemble", "prob_calibrated")
    contributions = explain(model_a, ready, meta, inputs.features)
    if out:
        write_csv(shown.orderBy(F.col("prob_calibrated").desc(), *meta), f"{out}/predictions_current")
        write_table(contributions, f"{out}/contributions_current")
        write_table(ready.drop("features"), f"{out}/features_current")
    return shown.orderBy(F.col("prob_calibrated").desc(), *meta), contributions
