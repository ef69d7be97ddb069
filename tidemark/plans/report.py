"""Tables of the validation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import start_year
from tidemark.operators import evaluate, explore
from tidemark.sources import config

# Sizes of the report lists.
LISTED, FALSE_POSITIVES, TOP_FEATURES = 20, 50, 10
REPORT_KS = [10, 20, 50, 100, 200, 500]


def season_reasons(columns: list[str]) -> Column:
    """Why a hit may have been missed, from its feature row; a column that was pruned gives no reason."""
    low = F.concat(F.lit("low minutes ("), F.col("minutes").cast("int").cast("string"), F.lit(")"))
    checks = {
        "age": (F.col("age") >= 27, "older (age >= 27)"),
        "minutes": (F.col("minutes") < 1000, low),
        "goals_per90": ((F.col("goals_per90") < 0.05) & F.col("position").isin("FW", "FW,MF"), "low goal rate"),
    }
    return explore.reasons([check for column, check in checks.items() if column in columns])


def validation_report(
    predictions: DataFrame,
    features: DataFrame,
    history: DataFrame,
    importance: DataFrame,
    summary: DataFrame,
    tie: str,
    entity: str = "player_id",
    period: str = "season",
    tier: str = "league",
    destination: str = "breakout_league",
    in_target: Column | None = None,
    reason: Column | None = None,
    score: str = "prob_calibrated",
) -> dict[str, DataFrame]:
    """All tables; each is a small result over the whole prediction table."""
    best, worst = [F.col(score).desc(), F.col(tie).asc()], [F.col(score).asc(), F.col(tie).asc()]
    hits = predictions.where(F.col("label") == 1)
    first = [F.col(c).asc() for c in (tie, tier, period) if c in features.columns]
    missed = explore.look_up(explore.top_rows(hits, LISTED, worst), features, [entity, period], first)
    false = explore.top_rows(predictions.where(F.col("label") == 0), FALSE_POSITIVES, best)
    if in_target is None:
        in_target = F.col(tier).isin(config.league_names("target"))
    top = explore.top_rows(predictions, LISTED, best)
    if "birth_year" in predictions.columns:
        top = top.withColumn("age", start_year(F.col(period)) - F.col("birth_year"))
    auc = summary.where((F.col("metric") == "roc_auc") & (F.col("model") == "calibrated"))
    return {
        "top": top,
        "true_positives": explore.top_rows(hits, LISTED, best),
        "missed": missed.withColumn("reason", season_reasons(missed.columns) if reason is None else reason),
        "thresholds": evaluate.threshold_metrics(predictions, [], score=score),
        "top_k": evaluate.topk_metrics(predictions, [], tie, REPORT_KS, score=score),
        "false_positives": explore.seen_in_target(false, history, entity, in_target, "near_miss"),
        "per_fold": predictions.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives")
        ),
        "per_league": evaluate.group_breakdown(predictions, tier, score=score),
        "destinations": evaluate.share_by(hits, destination),
        "top_features": explore.top_rows(importance, TOP_FEATURES, [F.col("importance").desc(), F.col("feature").asc()]),
        "verdict": auc.select(F.col("mean").alias("roc_auc"), evaluate.verdict(F.col("mean")).alias("verdict")),
    }
