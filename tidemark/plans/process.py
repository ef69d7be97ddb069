"""From source tables to labelled, engineered, pruned and folded feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import start_year
from tidemark.models.proxy import proxy_pipeline
from tidemark.operators.clean import clean
from tidemark.operators.features import engineer
from tidemark.operators.label import generate_labels, leakage_report, walk_forward_folds
from tidemark.operators.match import match_sources
from tidemark.operators.select import select_features
from tidemark.shared import keep
from tidemark.sources import config
from tidemark.sources.tables import without_nan, write_report, write_table


def feature_frame(
    enriched: DataFrame, proxy_path: str | None, rounds: int, strict: bool, train: bool = True
) -> tuple[DataFrame, dict | None]:
    """Engineered features with the proxy measure in place before the interactions use it.

    ``train`` false only loads the proxy model, as scoring must.
    """
    figures: list[dict | None] = []

    def proxy(df: DataFrame) -> DataFrame:
        applied, found = proxy_pipeline(keep(df, "rated"), proxy_path, rounds=rounds, train=train)
        figures.append(found)
        return applied

    return engineer(enriched, strict=strict, before_interactions=proxy), figures[0]


def process(
    counts: DataFrame,
    market: DataFrame,
    expected: DataFrame,
    out: str,
    folds: list[tuple] | None = None,
    proxy_rounds: int = 200,
    strict: bool = False,
) -> dict[str, DataFrame]:
    """Run all stages; each stage is written to ``out`` and the next one reads it from there."""
    spark = counts.sparkSession
    counts, market, expected = without_nan(counts), without_nan(market), without_nan(expected)

    def stage(df: DataFrame, name: str) -> DataFrame:
        write_table(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    enriched = stage(match_sources(keep(clean(counts), "cleaned"), market, expected), "enriched")
    labelled = stage(generate_labels(counts, enriched), "labeled")
    features, figures = feature_frame(labelled, f"{out}/proxy_model", proxy_rounds, strict)
    selected, report = select_features(keep(features, "features"))
    final = stage(selected, "features")
    year = start_year(F.col("season"))
    placed = walk_forward_folds(final, year, folds or config.FOLDS)
    write_table(placed, f"{out}/folds", ["fold", "split"])
    stored = spark.read.parquet(f"{out}/folds")
    write_report(spark, {**report, "proxy": figures}, f"{out}/selection_report")
    return {
        "enriched": enriched,
        "labeled": labelled,
        "features": final,
        "folds": stored,
        "leakage": leakage_report(stored, "player_id", "season", year),
    }
