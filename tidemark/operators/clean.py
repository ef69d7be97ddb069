"""Category mapping, row filters and per-group capping of outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import mapping, position_group
from tidemark.operators.order_stats import exact_quantiles
from tidemark.shared import attach
from tidemark.sources import config

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame, protected: list[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in protected]


def with_position_group(df: DataFrame, position: str = "position", source: str = "counts") -> DataFrame:
    """Add ``position_group``: 'market' texts by their own table, else the first listed code."""
    if source == "market":
        return df.withColumn("position_group", mapping(config.MARKET_POSITIONS, F.trim(F.col(position))))
    return df.withColumn("position_group", position_group(F.col(position), config.GROUP_CODES))


def keep_eligible(
    df: DataFrame,
    group: str = "position_group",
    age: str = "age",
    exposure: str = "minutes",
    excluded_group: str = "GK",
    min_exposure: float = config.MIN_MINUTES,
    min_age: int = config.MIN_AGE,
    max_age: int = config.MAX_AGE,
) -> DataFrame:
    """Rows outside the excluded group, inside the age range, with enough exposure."""
    return df.where(
        (F.col(group) != excluded_group) & F.col(age).between(min_age, max_age) & (F.col(exposure) >= min_exposure)
    )


def cap_outliers(
    df: DataFrame, group: str, columns: list[str], q: float = 0.99, count_name: str | None = None
) -> DataFrame:
    """Cap each column at its exact group percentile; integer columns cap at the truncated value.

    ``count_name`` adds the number of values capped in the row, whose sum is the report figure.
    """
    caps = exact_quantiles(df, [group], columns, q)
    caps = caps.select(group, *[F.col(c).alias(f"_cap_{c}") for c in columns])
    joined = attach(df, caps, [group])
    capped, exceeded = {}, F.lit(0)
    for c in columns:
        kind = df.schema[c].dataType
        limit = F.col(f"_cap_{c}")
        if isinstance(kind, _INTEGERS):
            limit = limit.cast(kind)
        over = F.coalesce(F.col(c) > limit, F.lit(False))
        capped[c] = F.when(over, limit).otherwise(F.col(c))
        exceeded = exceeded + over.cast("int")
    shown = [capped[c].alias(c) if c in capped else F.col(c) for c in df.columns]
    if count_name:
        shown.append(exceeded.alias(count_name))
    return joined.select(*shown)


def clean(df: DataFrame, position: str = "position", **filters) -> DataFrame:
    """Map positions, drop unmapped rows, filter, cap every numeric column that is not exempt."""
    grouped = with_position_group(df, position).where(F.col("position_group").isNotNull())
    eligible = keep_eligible(grouped, **filters)
    columns = numeric_columns(eligible, [*config.UNCAPPED, "label"])
    return cap_outliers(eligible, "position_group", columns)


def cleaning_report(df: DataFrame, position: str = "position", **filters) -> DataFrame:
    """Row counts after each cleaning step, in one pass over the input."""
    low, high = filters.get("min_age", config.MIN_AGE), filters.get("max_age", config.MAX_AGE)
    minutes = filters.get("min_exposure", config.MIN_MINUTES)
    grouped = with_position_group(df, position)
    known = F.col("position_group").isNotNull()
    outfield = known & (F.col("position_group") != "GK")
    aged = outfield & F.col("age").between(low, high)
    return grouped.agg(
        F.count(F.lit(1)).alias("total_raw"),
        F.count_if(known).alias("after_position_norm"),
        F.count_if(known & ~outfield).alias("gk_removed"),
        F.count_if(aged).alias("after_age_filter"),
        F.count_if(aged & (F.col("minutes") >= minutes)).alias("after_minutes_filter"),
    )
