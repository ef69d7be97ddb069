"""Declared tables: schemas, scans, conforming loads, upserts and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import all_of
from tidemark.operators.unify import latest_per_key, upsert
from tidemark.shared import keep

KEY = ["player_id", "league", "season"]
PARTITIONS = ["league", "season"]


def _schema(text: str, required: str = "player_id name league season") -> T.StructType:
    """StructType from 'type: names' lines; key and name are not nullable."""
    kinds = {
        "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
        "timestamp": T.TimestampType(),
    }
    fields = []
    for line in text.strip().splitlines():
        kind, names = line.split(":")
        fields += [T.StructField(n, kinds[kind.strip()], n not in required.split()) for n in names.split()]
    return T.StructType(fields)


# Columns of the counts source.
COUNTS_SCHEMA = _schema(
    """
    string: player_id name position team nationality
    int: age birth_year games games_starts minutes
    double: minutes_90s
    int: goals assists goals_assists goals_pens pens_made pens_att
    double: xg npxg xg_assist npxg_xg_assist
    int: cards_yellow cards_red progressive_carries progressive_passes progressive_passes_received
    int: shots shots_on_target
    double: shots_on_target_pct shots_per90 shots_on_target_per90 goals_per_shot goals_per_shot_on_target
    double: average_shot_distance
    int: shots_free_kicks
    double: npxg_per_shot xg_net npxg_net
    int: passes_completed passes
    double: passes_pct
    int: passes_total_distance passes_progressive_distance passes_completed_short passes_short
    double: passes_pct_short
    int: passes_completed_medium passes_medium
    double: passes_pct_medium
    int: passes_completed_long passes_long
    double: passes_pct_long
    int: assisted_shots passes_into_final_third passes_into_penalty_area crosses_into_penalty_area
    int: tackles tackles_won tackles_def_3rd tackles_mid_3rd tackles_att_3rd challenge_tackles challenges
    double: challenge_tackles_pct
    int: challenges_lost blocks blocked_shots blocked_passes interceptions tackles_interceptions clearances errors
    int: touches touches_def_pen_area touches_def_3rd touches_mid_3rd touches_att_3rd touches_att_pen_area
    int: touches_live_ball take_ons take_ons_won
    double: take_ons_won_pct
    int: take_ons_tackled
    double: take_ons_tackled_pct
    int: carries carries_distance carries_progressive_distance carries_into_final_third
    int: carries_into_penalty_area miscontrols dispossessed passes_received
    string: league season source
    timestamp: scraped_at
    """
)
# Columns of the market source.
MARKET_SCHEMA = _schema(
    """
    string: player_id player_slug name position team
    int: age
    string: nationality
    long: market_value_eur
    string: league season source
    timestamp: scraped_at
    """
)
# Columns of the expected-goals source.
EXPECTED_SCHEMA = _schema(
    """
    string: player_id name position team
    int: games minutes
    double: minutes_90s
    int: goals assists npg
    double: xg xa npxg xg_chain xg_buildup xg_per90 xa_per90 npxg_per90 goals_per90 assists_per90
    int: shots key_passes yellow_cards red_cards
    double: xg_overperformance xa_overperformance
    string: league season source
    timestamp: scraped_at
    """
)
SCHEMAS = {"counts": COUNTS_SCHEMA, "market": MARKET_SCHEMA, "expected": EXPECTED_SCHEMA}


def scan(spark: SparkSession, path: str, equals: dict[str, object] | None = None) -> DataFrame:
    """Parquet scan with optional equality filters; a filter of None is not applied. NaN is read as NULL."""
    df = spark.read.parquet(path)
    for column, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return without_nan(df)


def sql(spark: SparkSession, statement: str, params: dict | list | None = None, **frames: DataFrame) -> DataFrame:
    """Parameterised SQL; ``{name}`` in the statement stands for the frame of that name."""
    return spark.sql(statement, args=params, **frames)


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Columns of the schema only: unknown ones are dropped, missing ones are the default or NULL."""
    defaults = defaults or {}

    def column(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return defaults.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema])


def load_records(records: DataFrame, source: str) -> DataFrame:
    """Records of a source in its declared schema, stamped; rows without a key or name are refused."""
    schema = SCHEMAS[source]
    conformed = conform(records, schema, {"source": F.lit(source), "scraped_at": F.current_timestamp()})
    for field in schema:
        if not field.nullable:
            conformed = conformed.withColumn(
                field.name,
                F.when(F.col(field.name).isNull(), F.raise_error(F.lit(f"{field.name} must not be NULL"))).otherwise(
                    F.col(field.name)
                ),
            )
    return conformed


def write_upsert(
    incoming: DataFrame, path: str, keys: list[str] = KEY, partitions: list[str] = PARTITIONS, newest: str | None = None
) -> int:
    """Insert or replace by key in a partitioned parquet table; only the touched partitions are rewritten.

    Columns that only one side has stay, NULL in the other side's rows. With ``newest`` the row with the
    latest value of that column wins, so a late record does not replace a newer stored one; an incoming
    row wins a tie.
    Returns the number of incoming rows, 0 leaves the table as it is. The merged rows are written to
    the shared folder first, since a table cannot be read and overwritten in one job.
    """
    spark = incoming.sparkSession
    incoming = keep(incoming, "incoming")
    rows = incoming.count()
    if not rows:
        return 0
    try:
        stored = spark.read.option("mergeSchema", True).parquet(path)
    except Exception as missing:  # the first load finds no table
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = spark.createDataFrame([], incoming.schema)
    touched = keep(incoming.select(*[F.col(c).alias(f"_hit_{c}") for c in partitions]).distinct(), "touched")
    affected = stored.join(touched, all_of([F.col(c).eqNullSafe(F.col(f"_hit_{c}")) for c in partitions]), "left_semi")
    if newest:
        both = affected.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        found = latest_per_key(both, keys, [F.col(newest).desc_nulls_last(), F.col("_new").desc()]).drop("_new")
    else:
        found = upsert(affected, incoming, keys)
    merged = keep(found, "merged")
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )
    return rows


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL, so that means, medians and ranks skip missing values."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as one JSON line; its size depends on columns, not on rows."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
