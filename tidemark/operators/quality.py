"""Source statistics and data-quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_stats(sources: dict[str, DataFrame], group: str, period: str) -> DataFrame:
    """Rows per source, and distinct groups and periods over all sources: one row."""
    tagged = [df.select(F.lit(name).alias("_source"), group, period) for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, tagged)
    pairs = every.groupBy("_source", group, period).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("_source") == name, F.col("_n"))), F.lit(0)).alias(f"{name}_rows")
            for name in sources
        ],
        F.count_distinct(group).alias("groups"),
        F.count_distinct(period).alias("periods"),
    )


def distinct_union(frames: list[DataFrame], column: str) -> DataFrame:
    """UNION of one column; each input is reduced to its distinct values before they meet."""
    return reduce(DataFrame.union, [f.select(column).distinct() for f in frames]).distinct()


def quality_report(
    unified: DataFrame, keys: list[str], ids: list[str], watched: dict[str, str], expected: dict[str, str]
) -> DataFrame:
    """Per key: rows, rows per source, share of rows known to two or more sources, missing values, warnings.

    ``ids`` are the source id columns, ``watched`` maps a report column to the column whose missing
    values it counts, ``expected`` maps an id column to the warning raised when no row has it.
    """
    known = sum((F.col(i).isNotNull().cast("int") for i in ids), F.lit(0))
    report = unified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unified_rows"),
        *[F.count(i).alias(f"{i}_rows") for i in ids],
        F.avg((known >= 2).cast("int")).alias("match_rate"),
        *[F.count_if(F.col(c).isNull()).alias(name) for name, c in watched.items()],
    )
    warnings = [F.when(F.col(f"{i}_rows") == 0, F.lit(text)) for i, text in expected.items()]
    warnings.append(F.when(F.col("match_rate") < 0.5, F.lit("low match rate")))
    for name in watched:
        many = F.col(name) > F.col("unified_rows") * 0.5
        warnings.append(F.when(many, F.lit(f"more than half: {name}")))
    return report.withColumn("warnings", F.concat_ws("; ", *warnings))


def overall_counts(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Rows, positives and distinct values of each column."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("positives"),
        *[F.count_distinct(c).alias(f"{c}_values") for c in columns],
    )
