"""Forward-window labels, walk-forward folds and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import start_year
from tidemark.sources import config


def forward_label(
    df: DataFrame,
    entity: str,
    tier: str,
    year: str,
    exposure: str,
    source: list[str],
    target: list[str],
    years: int = config.LOOKFORWARD_YEARS,
    min_exposure: float = config.MIN_TARGET_MINUTES,
    period: str | None = None,
) -> DataFrame:
    """Label source-tier rows: does the entity reach a target tier within the next ``years``?

    1 if it does with enough exposure, 0 if not and the window is complete, dropped otherwise. The
    earliest (year, tier) is reported, with ``period`` also the text of that period. Qualifying rows
    are reduced to one per (entity, year), turned into the at most ``years`` earlier years they
    answer, and met with an equi-join: no self-join by entity, no window over the rows of an entity.
    """
    hits = (
        df.where(F.col(tier).isin(target) & (F.col(exposure) >= min_exposure))
        .groupBy(entity, year)
        .agg(F.min(F.struct(F.col(tier).alias("tier"), F.col(period or year).alias("period"))).alias("_at"))
    )
    answers = (
        hits.withColumn("_hit", F.struct(F.col(year).alias("target_year"), F.col("_at")))
        .select(entity, F.explode(F.sequence(F.col(year) - years, F.col(year) - 1)).alias(year), "_hit")
        .groupBy(entity, year)
        .agg(F.min("_hit").alias("_hit"))
    )
    found_at = {"target_tier": F.col("_hit._at.tier"), "target_year": F.col("_hit.target_year")}
    if period:
        found_at["target_period"] = F.col("_hit._at.period")
    last_year = df.agg(F.max(year)).scalar()
    found = F.col("_hit").isNotNull()
    label = F.when(found, 1).when(F.col(year) + years <= last_year, 0)
    return (
        df.where(F.col(tier).isin(source))
        .join(answers, on=[entity, year], how="left")
        .withColumn("label", label)
        .where(F.col("label").isNotNull())
        .withColumns(found_at)
        .drop("_hit")
    )


def attach_labels(enriched: DataFrame, labels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Inner join of label columns on the row key."""
    return enriched.join(labels.select(*keys, *columns), on=keys, how="inner")


def season_labels(counts: DataFrame) -> DataFrame:
    """Labels of the default profile: feeder-league seasons that lead to a season in a target league."""
    dated = counts.withColumn("_year", start_year(F.col("season")))
    found = forward_label(
        dated,
        "player_id",
        "league",
        "_year",
        "minutes",
        config.league_names("source"),
        config.league_names("target"),
        period="season",
    )
    renamed = {"target_tier": "breakout_league", "target_period": "breakout_season"}
    return found.withColumnsRenamed(renamed).drop("_year", "target_year")


def generate_labels(counts: DataFrame, enriched: DataFrame) -> DataFrame:
    """Enriched rows with their label; the history behind it is all of ``counts``."""
    keys = ["player_id", "league", "season"]
    return attach_labels(enriched, season_labels(counts), keys, ["label", "breakout_league", "breakout_season"])


def label_totals(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.avg("label").alias("positive_rate"),
    )


def labeling_report(df: DataFrame, labels: DataFrame, tier: str, source: list[str]) -> DataFrame:
    """Totals and the number of source rows left out for an incomplete window."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total_observations"), F.count_if(F.col(tier).isin(source)).alias("_source_rows")
    )
    found = label_totals(labels)
    return found.select(
        totals.select("total_observations").scalar().alias("total_observations"),
        "observations",
        "positives",
        "negatives",
        "positive_rate",
        (totals.select("_source_rows").scalar() - F.col("observations")).alias("excluded_lookforward"),
    )


def label_distribution(labels: DataFrame, tier: str, period: str) -> DataFrame:
    """Counts overall, by tier and by period in one pass."""
    return labels.groupingSets([[], [F.col(tier)], [F.col(period)]], F.col(tier), F.col(period)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("positives"),
        F.avg("label").alias("positive_rate"),
    )


def single_class_periods(labels: DataFrame, period: str) -> DataFrame:
    """Periods that hold one class only: evaluation on them is unreliable."""
    return (
        labels.groupBy(period)
        .agg(F.min("label").alias("only_class"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("n"))
        .where(F.col("only_class") == F.col("_high"))
        .drop("_high")
    )


def walk_forward_folds(df: DataFrame, year: Column, folds: list[tuple] | None = None) -> DataFrame:
    """One row per (row, fold, split it belongs to) with columns ``fold`` and ``split``.

    A badly chosen fold may place a row in two splits; the leakage report then says so. The few folds
    are expressions on the row: no join and no shuffle.
    """
    places = []
    for fold, train_end, validation, test in folds or config.FOLDS:
        members = {"train": year <= train_end, "val": year == validation, "test": year == test}
        for split, member in members.items():
            places.append(F.when(member, F.struct(F.lit(fold).alias("fold"), F.lit(split).alias("split"))))
    placed = F.filter(F.array(*places), lambda place: place.isNotNull())
    return df.withColumn("_place", F.explode(placed)).select(*df.columns, "_place.fold", "_place.split")


def leakage_report(folds: DataFrame, entity: str, period: str, year: Column) -> DataFrame:
    """Per fold: year bounds of the splits, shared (entity, period) keys, and the warnings they give.

    An empty split has NULL bounds and raises no warning.
    """
    bounds = folds.groupBy("fold").agg(
        *[
            fn(F.when(F.col("split") == split, year)).alias(f"{split}_{name}")
            for split in ("train", "val", "test")
            for name, fn in (("min", F.min), ("max", F.max))
        ]
    )
    shared = (
        folds.groupBy("fold", entity, period)
        .agg(F.bool_or(F.col("split") == "train").alias("_train"), F.bool_or(F.col("split") == "val").alias("_val"))
        .groupBy("fold")
        .agg(F.count_if(F.col("_train") & F.col("_val")).alias("shared_keys"))
    )
    checks = [
        (F.col("train_max") >= F.col("val_min"), "train overlaps val"),
        (F.col("train_max") >= F.col("test_min"), "train overlaps test"),
        (F.col("val_max") >= F.col("test_min"), "val overlaps test"),
        (F.col("shared_keys") > 0, "keys in both train and val"),
    ]
    warnings = F.concat_ws("; ", *[F.when(condition, F.lit(text)) for condition, text in checks])
    return bounds.join(shared, on="fold").withColumn("warnings", warnings)
