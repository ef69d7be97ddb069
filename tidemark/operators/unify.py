"""Upserts, full outer unification and merges of sources that share a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import keep


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in the given order.

    Spark keeps one row per key and map task before the shuffle, so a key with very many copies
    costs no more than one with few.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == 1).drop("_rank")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], tie: list[Column] | None = None) -> DataFrame:
    """Existing rows, replaced by incoming rows of the same key."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return latest_per_key(both, keys, [F.col("_new").desc(), *(tie or [])]).drop("_new")


def full_outer(left: DataFrame, right: DataFrame, on: list[tuple[Column, Column]]) -> DataFrame:
    """Full outer equi-join as a left join and the right rows that met nothing.

    Spark cannot split a skewed key of a full outer join, but it can split the left side of a left
    join and of an anti join. NULL keys never match, as in SQL.
    """
    condition = reduce(lambda a, b: a & b, [x == y for x, y in on])
    matched = left.join(right, on=condition, how="left")
    known = left.select(*[x.alias(f"_k{i}") for i, (x, _) in enumerate(on)]).distinct()
    seen = reduce(lambda a, b: a & b, [known[f"_k{i}"] == y for i, (_, y) in enumerate(on)])
    return matched.unionByName(right.join(known, on=seen, how="left_anti"), allowMissingColumns=True)


def unify_three(
    a: DataFrame,
    b: DataFrame,
    c: DataFrame,
    lower_keys: list[str],
    plain_keys: list[str],
    columns: dict[str, list[tuple[str, str]]],
) -> DataFrame:
    """Full outer join of three sources on case-insensitive and plain keys.

    ``columns`` names each output with its sources in order of priority, as (source, column) with
    sources 'a', 'b', 'c'. The third source joins on the coalesced keys of the first two.
    """

    def prefixed(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*[F.col(x).alias(f"{mark}_{x}") for x in df.columns])

    def keys(mark_of) -> list[Column]:
        return [F.lower(mark_of(k)) for k in lower_keys] + [mark_of(k) for k in plain_keys]

    first, second, third = prefixed(a, "a"), prefixed(b, "b"), prefixed(c, "c")
    pair = full_outer(first, second, list(zip(keys(lambda k: F.col(f"a_{k}")), keys(lambda k: F.col(f"b_{k}")))))
    pair = keep(pair, "pair")  # both halves of the next join read it
    merged = keys(lambda k: F.coalesce(F.col(f"a_{k}"), F.col(f"b_{k}")))
    whole = full_outer(pair, third, list(zip(merged, keys(lambda k: F.col(f"c_{k}")))))
    return whole.select(
        *[F.coalesce(*[F.col(f"{mark}_{col}") for mark, col in sources]).alias(out) for out, sources in columns.items()]
    )


# Unified columns and their sources by priority (a counts, b market, c expected goals).
UNIFIED_COLUMNS = {
    **{k: [("a", k), ("b", k), ("c", k)] for k in ("name", "team", "position", "league", "season")},
    "age": [("b", "age"), ("a", "age")],
    "nationality": [("a", "nationality"), ("b", "nationality")],
    "market_value_eur": [("b", "market_value_eur")],
    **{k: [("a", k), ("c", k)] for k in ("minutes", "games", "goals", "assists")},
    "xg": [("c", "xg"), ("a", "xg")],
    "xa": [("c", "xa"), ("a", "xg_assist")],
    "npxg": [("c", "npxg"), ("a", "npxg")],
    **{k: [("c", k)] for k in ("xg_chain", "xg_buildup", "xg_overperformance", "xa_overperformance")},
    **{
        k: [("a", k)]
        for k in (
            "shots", "shots_on_target", "passes_completed", "passes", "passes_pct", "progressive_passes",
            "progressive_carries", "tackles", "interceptions", "blocks", "touches", "take_ons_won",
        )
    },
    "fbref_id": [("a", "player_id")],
    "transfermarkt_id": [("b", "player_id")],
    "understat_id": [("c", "player_id")],
}


def unified_players(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    return unify_three(a, b, c, ["name", "team"], ["league", "season"], UNIFIED_COLUMNS)


def merge_overwrite(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Left-join further tables; where a table has the key, its values replace shared columns, NULLs too."""
    for other in others:
        shared = [c for c in other.columns if c != key and c in base.columns]
        fresh = [c for c in other.columns if c != key and c not in base.columns]
        marked = other.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_o_{c}") for c in shared], *fresh)
        joined = base.join(marked, on=key, how="left")
        columns = [
            F.when(F.col("_hit"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c)
            for c in base.columns
        ]
        base = joined.select(*columns, *fresh)
    return base


def union_shared(history: DataFrame, current: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """UNION ALL on the shared columns; ``defaults`` fill columns the current rows lack."""
    filled = current.withColumns({c: v for c, v in defaults.items() if c not in current.columns})
    shared = [c for c in history.columns if c in filled.columns]
    return history.select(*shared).unionByName(filled.select(*shared))
