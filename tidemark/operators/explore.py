"""Rankings, percentiles, profiles, neighbours and look-ups for single entities."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.order_stats import long_values, row_numbers, running_totals

QUERIES_PER_PASS = 1024
ROWS_PER_SLICE = 50_000


def ranked(df: DataFrame, score: str, tie: str, name: str = "rank") -> DataFrame:
    """All rows with their rank by score, without sorting them in one task."""
    return row_numbers(df, [], score, tie, name)


def top_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First n rows in the order: a top-k report, kept per task before the rows meet."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First n rows of each group; Spark cuts each task to n rows a group before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def peer_percentiles(df: DataFrame, row_id: str, group: str, columns: list[str]) -> DataFrame:
    """Share of group peers at or below the value, times 100, as (row_id, group, feature, percentile).

    A missing value, and a feature without any value in the group, give 50.
    """
    values = long_values(df, [row_id, group], columns)
    counts = values.groupBy(group, "feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, [group, "feature"], ["value"], ["_n"])
    shares = placed.select(group, "feature", "value", (F.col("_n_upto") / F.col("_n_all") * 100).alias("percentile"))
    everything = df.select(row_id, group, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [row_id, group], columns, "feature", "value"
    )
    joined = everything.join(shares, on=[group, "feature", "value"], how="left")
    return joined.select(row_id, group, "feature", F.coalesce("percentile", F.lit(50.0)).alias("percentile"))


def radar_profile(percentiles: DataFrame, row_id: str, group: str, features: dict[str, list[str]]) -> DataFrame:
    """Percentiles of the features listed for the row's group, next to the group middle of 50."""
    wanted = F.lit(False)
    for name, listed in features.items():
        wanted = wanted | ((F.col(group) == name) & F.col("feature").isin(listed))
    return percentiles.where(wanted).select(row_id, group, "feature", "percentile", F.lit(50.0).alias("group_average"))


def standardized(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """Array of (value - mean) / population deviation; deviation 0 counts as 1, missing values as 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    # One row of two numbers a column: its size does not depend on the data.
    parts = []
    for i, c in enumerate(columns):
        mean, spread = stats[f"m_{i}"] or 0.0, stats[f"s_{i}"] or 1.0
        parts.append(F.coalesce((F.col(c).cast("double") - F.lit(mean)) / F.lit(spread), F.lit(0.0)))
    return df.withColumn(name, F.array(*parts))


def _closest(
    queries: pd.DataFrame, rows: pd.DataFrame, row_id: str, features: str, n: int
) -> Iterator[pd.DataFrame]:
    """The n nearest rows of one batch for each query, the row itself left out."""
    matrix = np.stack(rows[features].to_numpy()).astype("float64")
    ids = rows[row_id].to_numpy()
    for query_id, vector in zip(queries["query_id"], queries["query_features"]):
        distance = np.sqrt(((matrix - np.asarray(vector, dtype="float64")) ** 2).sum(axis=1))
        others = np.flatnonzero(ids != query_id)
        near = others[np.lexsort((ids[others], distance[others]))][:n]
        yield pd.DataFrame({"query_id": query_id, row_id: ids[near], "distance": distance[near]})


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, row_id: str, n: int = 5, features: str = "features", only: Column | None = None
) -> DataFrame:
    """The n nearest rows by Euclidean distance for each query row, as (query_id, row_id, distance, rank).

    Few queries travel with the code and every batch of rows returns its n best. More queries than
    fit one pass meet the rows in a grid of (query pass, row slice), each cell bounded in size.
    """
    asked = queries.select(F.col(row_id).alias("query_id"), F.col(features).alias("query_features"))
    candidates = (rows.where(only) if only is not None else rows).select(row_id, features)
    id_type = rows.schema[row_id].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField(row_id, id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    count = asked.count()
    if count <= QUERIES_PER_PASS:
        local = asked.toPandas()

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield from _closest(local, batch, row_id, features, n)

        near = candidates.mapInPandas(scan, schema)
    else:
        passes = ceil(count / QUERIES_PER_PASS)
        slices = max(1, ceil(candidates.count() / ROWS_PER_SLICE))

        def part(key: str, parts: int) -> Column:
            return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

        def every(parts: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

        grid_q = asked.withColumn("_pass", part("query_id", passes)).withColumn("_slice", every(slices))
        grid_r = candidates.withColumn("_slice", part(row_id, slices)).withColumn("_pass", every(passes))

        def cell(asked_here: pd.DataFrame, rows_here: pd.DataFrame) -> pd.DataFrame:
            parts = list(_closest(asked_here, rows_here, row_id, features, n)) if len(rows_here) else []
            return pd.concat(parts) if parts else pd.DataFrame(columns=["query_id", row_id, "distance"])

        near = grid_q.groupBy("_pass", "_slice").cogroup(grid_r.groupBy("_pass", "_slice")).applyInPandas(cell, schema)
    return top_per_group(near, ["query_id"], [F.col("distance"), F.col(row_id)], n)


def seen_in_target(df: DataFrame, history: DataFrame, entity: str, condition: Column, name: str) -> DataFrame:
    """0/1 flag: did the entity ever appear in a row that meets the condition?"""
    seen = history.where(condition).select(entity).distinct().withColumn("_seen", F.lit(1))
    return df.join(seen, on=entity, how="left").withColumn(name, F.coalesce("_seen", F.lit(0))).drop("_seen")


def reasons(checks: list[tuple[Column, Column | str]], default: str = "model uncertainty") -> Column:
    """Texts of the checks that hold, joined by '; ', or the default where none does."""
    texts = [F.when(condition, F.lit(text) if isinstance(text, str) else text) for condition, text in checks]
    joined = F.concat_ws("; ", *texts)
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def look_up(df: DataFrame, features: DataFrame, keys: list[str], tie: list[Column]) -> DataFrame:
    """Left join of the first feature row per key; only columns that are new."""
    from tidemark.operators.unify import latest_per_key

    fresh = [c for c in features.columns if c not in df.columns]
    first = latest_per_key(features, keys, tie).select(*keys, *fresh)
    return df.join(first, on=keys, how="left")
