"""Imputation by group medians and pruning of features."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clean import numeric_columns
from tidemark.operators.features import PEERS
from tidemark.operators.order_stats import exact_quantiles
from tidemark.shared import attach, keep
from tidemark.sources import config


def _medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    found = exact_quantiles(df, keys, columns, 0.5)
    return found.select(*keys, *[F.col(c).alias(f"_median_{c}") for c in columns])


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    def fill(c: str):
        return F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}")).alias(c)

    return df.select(*[fill(c) if c in columns else F.col(c) for c in df.columns if not c.startswith("_median_")])


def impute_group_median(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fill with the median of the group, then with the median of the column so filled."""
    grouped = keep(_filled(attach(df, _medians(df, keys, columns), keys), columns), "imputed")
    whole = exact_quantiles(grouped, [], columns, 0.5).first()
    known = {c: m for c, m in (whole.asDict() if whole else {}).items() if m is not None}
    return apply_medians(grouped, known).select(*df.columns)


def fit_medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Column medians of the training rows, 0 for a column without values. One row, one value a column."""
    row = exact_quantiles(train, [], columns, 0.5).first()
    found = row.asDict() if row else {}
    return {c: 0.0 if found.get(c) is None else found[c] for c in columns}


def apply_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def variance_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample variance of each column as rows (feature, variance)."""
    wide = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "variance")


_PAIRS_PER_PASS = 150


def correlation_matrix(df: DataFrame, columns: list[str]):
    """Pearson matrix as a local array: its size depends on the number of columns only."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_vector").transform(df.select(*columns)).select("_vector")
    return Correlation.corr(vectors, "_vector").first()[0].toArray()


def correlation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair as rows (a, b, r), over the rows where both are known.

    All pairs are summed in as few passes as one aggregate of bounded width allows.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = []
    for low in range(0, len(pairs), _PAIRS_PER_PASS):
        part = pairs[low : low + _PAIRS_PER_PASS]
        found = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(part)]).first()
        rows += [(a, b, r) for (a, b), r in zip(part, found)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def low_variance(variances: dict[str, float | None], limit: float = config.VARIANCE_LIMIT) -> list[str]:
    return [c for c, v in variances.items() if v is None or v < limit]


def correlated(
    columns: list[str], matrix, variances: dict[str, float], limit: float = config.CORRELATION_LIMIT
) -> list[str]:
    """Columns to drop: of a correlated pair the one with the lower variance loses.

    Pairs above the limit are settled in order of their later column, then of their earlier one. A pair
    whose earlier column has lost before is passed over, one whose later column has lost is not.
    """
    strong = sorted((int(b), int(a)) for a, b in np.argwhere(np.triu(np.abs(np.asarray(matrix)) > limit, 1)))

    def settle(losers: frozenset[str], pair: tuple[int, int]) -> frozenset[str]:
        second, first = (columns[k] for k in pair)
        if first in losers:
            return losers
        return losers | {min(second, first, key=lambda c: (variances[c], c == second))}

    return sorted(reduce(settle, strong, frozenset()))


def select_features(
    df: DataFrame, keys: list[str] = PEERS, protected: list[str] | None = None
) -> tuple[DataFrame, dict[str, object]]:
    """Impute, drop low variance, drop correlated. Returns the frame and a report."""
    columns = numeric_columns(df, protected or config.PROTECTED)
    filled = keep(impute_group_median(df, keys, columns), "filled")
    variances = {r["feature"]: r["variance"] for r in variance_table(filled, columns).collect()}
    flat = low_variance({c: variances[c] for c in columns})
    rest = [c for c in columns if c not in flat]
    # A column without any value cannot be imputed; its variance is NULL and it is already gone.
    twins = correlated(rest, correlation_matrix(filled, rest), variances) if len(rest) > 1 else []
    kept = [c for c in rest if c not in twins]
    report = {
        "input_features": len(columns),
        "low_variance_removed": flat,
        "correlated_removed": twins,
        "final_features": len(kept),
        "features": kept,
    }
    return filled.drop(*flat, *twins), report


def align(df: DataFrame, features: list[str], others: list[str] | None = None) -> DataFrame:
    """Exactly the saved feature list in its order: missing ones are 0.0, extra ones are dropped."""
    columns = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in features]
    return df.select(*(others or []), *columns)
