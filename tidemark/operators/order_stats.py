"""Exact ranks, running totals and quantiles for groups too large for one task.

A window that is partitioned by the group alone puts the whole group in one task. Here every value
falls in a *cell*, a fixed function of the value that keeps the order. Counts per (group, cell) are
combined on the map side, their running total per group is small, and only the rows of one cell are
sorted together. The cell depends on nothing but the value, so recomputed partitions agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import attach, keep

CELLS_PER_E_FOLD = 4096
SMALLEST_STEP = 1e-6
CODE_POINTS = 0x110000


def value_cell(value: Column) -> Column:
    """Order-preserving cell number: signed logarithm, 4096 cells for each factor of e."""
    v = value.cast("double")
    size = F.floor(F.log1p(F.abs(v) / F.lit(SMALLEST_STEP)) * F.lit(float(CELLS_PER_E_FOLD)))
    return F.when(v < 0, -size).otherwise(size)


def tie_cell(df: DataFrame, column: str) -> Column:
    """Order-preserving cell: by value, by day or second, or by the first three letters of a text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.coalesce(F.unix_date(column).cast("long"), F.lit(-(2**63)))
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.unix_seconds(column), F.lit(-(2**63)))
    if not isinstance(kind, T.StringType):
        return F.coalesce(value_cell(F.col(column)), F.lit(-(2**63)))
    letters = [F.ascii(F.substring(column, i, 1)).cast("long") for i in (1, 2, 3)]
    return F.coalesce((letters[0] * CODE_POINTS + letters[1]) * CODE_POINTS + letters[2], F.lit(-(2**63)))


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[str],
    descending: bool = False,
) -> DataFrame:
    """Add ``<measure>_upto``, the total up to and including this row, and ``<measure>_all``, of the group.

    ``df`` holds one row per (keys, order), already aggregated. The first order column must be
    numeric and decides the direction; the others break ties upwards. Rows with a NULL key or a NULL
    first order column are left out, as grouping by a missing key does in the data model.
    """
    first = F.col(order[0])
    cell = -value_cell(first) if descending else value_cell(first)
    needed = [F.col(c).isNotNull() for c in [*keys, order[0]]]
    rows = df.withColumn("_cell", cell)
    for condition in needed:
        rows = rows.where(condition)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys, "_cell").agg(*[F.sum(m).alias(f"_{m}_cell") for m in measures])
    offsets = cells.select(
        *keys,
        "_cell",
        *[F.coalesce(F.sum(f"_{m}_cell").over(before), F.lit(0)).alias(f"_{m}_off") for m in measures],
        *[F.sum(f"_{m}_cell").over(Window.partitionBy(*keys)).alias(f"{m}_all") for m in measures],
    )
    direction = [first.desc() if descending else first.asc(), *[F.col(c).asc() for c in order[1:]]]
    inside = (
        Window.partitionBy(*keys, "_cell")
        .orderBy(*direction)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = rows.join(offsets, on=[*keys, "_cell"])
    totals = {f"{m}_upto": F.col(f"_{m}_off") + F.sum(m).over(inside) for m in measures}
    return joined.withColumns(totals).drop("_cell", *[f"_{m}_off" for m in measures])


def row_numbers(
    df: DataFrame, keys: list[str], score: str, tie: str, name: str, descending: bool = True
) -> DataFrame:
    """Number all rows of each group by score, ties by ``tie`` upwards.

    Equal to ``row_number()``, but the rows are sorted in ranges of (keys, score, tie), so neither a
    hot group nor one score shared by very many rows ends up in a single task. The sorted table is
    written, which fixes the place of every row; what is left is an offset for each range and the
    place where each group begins.
    """
    direction = F.col(score).desc() if descending else F.col(score).asc()
    ordered = df.orderBy(*keys, direction, F.col(tie).asc()).withColumn("_at", F.monotonically_increasing_id())
    placed = keep(ordered, "ordered").withColumn("_part", F.shiftrightunsigned("_at", 33))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    numbered = placed.join(keep(offsets, "offsets"), on="_part").withColumn(name, F.col("_offset") + inside + 1)
    if keys:
        begins = numbered.groupBy(*keys).agg((F.min(name) - 1).alias("_begin"))
        numbered = attach(numbered, begins, keys, "inner").withColumn(name, F.col(name) - F.col("_begin"))
    return numbered.select(*df.columns, name)


def long_values(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Unpivot numeric columns to (ids, feature, value), missing values left out."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(ids, columns, "feature", "value").where(F.col("value").isNotNull())


def exact_quantiles(df: DataFrame, keys: list[str], columns: list[str], q: float) -> DataFrame:
    """Linear-interpolated quantile ``q`` of each column per group: one row per group.

    Two passes. The first counts the cells of each (group, column) and keeps the one or two that hold
    the wanted ranks. That table is small and of known size, so the second pass filters the rows by it
    where they are; hardly any row is shuffled and no group is collected.
    """
    values = long_values(df, keys, columns).withColumn("_cell", value_cell(F.col("value")))
    for key in keys:
        values = values.where(F.col(key).isNotNull())
    group = [*keys, "feature"]
    counts = values.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    position = F.lit(q) * (F.col("_total") - 1)
    ranked = (
        counts.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)})
        .withColumns({"_lower": F.floor(position), "_upper": F.ceil(position), "_share": position - F.floor(position)})
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )

    def holds(rank: str) -> Column:
        return (F.col("_before") <= F.col(rank)) & (F.col(rank) < F.col("_upto"))

    wanted = ranked.where(holds("_lower") | holds("_upper")).select(
        *group, "_cell", "_before", "_lower", "_upper", "_share"
    )
    candidates = (
        values.join(keep(wanted, "cells"), on=[*group, "_cell"])
        .groupBy(*group, "_cell", "_before", "_lower", "_upper", "_share", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    inside = (
        Window.partitionBy(*group, "_cell").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = candidates.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)).withColumn(
        "_before", F.col("_upto") - F.col("_n")
    )
    low = F.max(F.when(holds("_lower"), F.col("value")))
    high = F.max(F.when(holds("_upper"), F.col("value")))
    found = placed.groupBy(*group).agg(low.alias("_low"), high.alias("_high"), F.max("_share").alias("_share"))
    interpolated = found.select(
        *group, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("value")
    )
    return interpolated.groupBy(*keys).pivot("feature", columns).agg(F.first("value"))
