"""Best match of records by similar names inside equal blocks, without comparing all pairs.

Copies are reduced first: only distinct (block, name, team) profiles are compared. Two names can
reach a similarity only if they share enough letters, so both sides emit combinations of their rarest
letters and meet in an equi-join on (block, both lengths, combination). This loses no pair: if a has
|a| letters and at least ``o`` of them must be shared, any ``t`` of the shared letters that come first
in a common order lie within the first |a| - o + t letters of a, and likewise for b.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import ceil, comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import normalize_name, record_score, similarity
from tidemark.shared import keep

NAME_WEIGHT, TEAM_WEIGHT = 0.8, 0.2
STRICT_RATIO = 0.9
MOST_SHARED = 4
MOST_COMBINATIONS = 128

# Letters of a normalised name from the most to the least frequent.
FREQUENT_FIRST = "eatoinshrdlcumwfgypbvkjxqz 0123456789-"
_RARITY = {letter: rank for rank, letter in enumerate(FREQUENT_FIRST)}


def needed_overlap(length_a: int, length_b: int, ratio: float) -> int:
    """Letters two names must share to reach the ratio 2 * LCS / (|a| + |b|)."""
    return max(1, ceil(ratio * (length_a + length_b) / 2 - 1e-9))


def shared_letters(length_a: int, length_b: int, ratio: float) -> int:
    """How many shared letters make one combination: as many as stay cheap for the longer name."""
    overlap = needed_overlap(length_a, length_b, ratio)
    spare = max(length_a, length_b) - overlap
    for t in range(min(MOST_SHARED, overlap), 1, -1):
        if comb(spare + t, t) <= MOST_COMBINATIONS:
            return t
    return 1


def numbered_letters(name: str) -> list[int]:
    """Letters with their occurrence number as one integer each, rarest first."""
    seen: Counter = Counter()
    tokens = []
    for letter in name:
        seen[letter] += 1
        tokens.append(seen[letter] * 64 + _RARITY.get(letter, 63))
    return sorted(tokens, reverse=True)


def combination_keys(name: str, ratio: float, is_left: bool) -> list[int]:
    """Join keys of one name. A clash of keys only adds a pair that is checked and dropped later."""
    own, tokens, keys = len(name), numbered_letters(name), []
    for other in range(ceil(ratio * own / (2 - ratio) - 1e-9), int(own * (2 - ratio) / ratio + 1e-9) + 1):
        pair = (own, other) if is_left else (other, own)
        overlap = needed_overlap(*pair, ratio)
        t = shared_letters(*pair, ratio)
        if overlap > min(pair):
            continue
        lengths = ((pair[0] & 0x7F) << 8 | (pair[1] & 0xFF)) << 48
        for chosen in combinations(tokens[: own - overlap + t], t):
            key = 0
            for token in chosen:
                key = key << 12 | (token & 0xFFF)
            keys.append(lengths | key)
    return keys


def _keys(name: Column, ratio: float, is_left: bool) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(names: pd.Series) -> pd.Series:
        return names.map(lambda n: combination_keys(n, ratio, is_left))

    return keys(name)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _letters(names: pd.Series) -> pd.Series:
    return names.map(numbered_letters)


def profiles(df: DataFrame, blocks: list[str], name: str, team: str) -> DataFrame:
    """Rows with normalised name and team; a missing team becomes empty and scores 0."""
    return df.withColumns({"_name": normalize_name(F.col(name)), "_team": normalize_name(F.col(team))})


def similar_names(left: DataFrame, right: DataFrame, blocks: list[str], ratio: float) -> DataFrame:
    """Pairs of distinct names of one block that reach ``ratio``, each once, with their similarity."""
    a = left.select(*blocks, "_name").distinct()
    b = right.select(*blocks, F.col("_name").alias("_rname")).distinct()
    a = a.withColumns({"_a": _letters("_name"), "_keys": _keys(F.col("_name"), ratio, True)})
    b = b.withColumns({"_b": _letters("_rname"), "_keys": _keys(F.col("_rname"), ratio, False)})
    a = a.select(*blocks, "_name", "_a", F.explode("_keys").alias("_key"))
    b = b.select(*blocks, "_rname", "_b", F.explode("_keys").alias("_key"))
    enough = 2 * F.size(F.array_intersect("_a", "_b")) >= F.lit(ratio - 1e-9) * (F.size("_a") + F.size("_b"))
    pairs = a.join(b, on=[*blocks, "_key"]).where(enough).select(*blocks, "_name", "_rname").distinct()
    return pairs.withColumn("_similarity", similarity("_name", "_rname")).where(
        F.col("_similarity") >= 100 * ratio - 1e-9
    )


def _scored_pairs(left: DataFrame, right: DataFrame, blocks: list[str], ratio: float) -> DataFrame:
    """Profile pairs whose names reach ``ratio``, with their record score."""
    offered = right.select(*blocks, F.col("_name").alias("_rname"), F.col("_team").alias("_rteam"), "_rid")
    alike = similar_names(left, right, blocks, ratio).join(left, on=[*blocks, "_name"]).join(offered, on=[*blocks, "_rname"])
    return alike.withColumn("_score", record_score(F.col("_similarity"), similarity("_team", "_rteam")))


def _best(pairs: DataFrame, blocks: list[str]) -> DataFrame:
    """Highest score per left profile; equal scores go to the smallest right id."""
    best = F.min(F.struct((-F.col("_score")).alias("minus"), F.col("_rid").alias("id"))).alias("_best")
    return pairs.groupBy(*blocks, "_name", "_team").agg(best).select(
        *blocks, "_name", "_team", F.col("_best.id").alias("_rid"), (-F.col("_best.minus")).alias("_score")
    )


def best_match(
    left: DataFrame,
    right: DataFrame,
    blocks: list[str],
    right_id: str,
    name: str = "name",
    team: str = "team",
    threshold: float = 80.0,
    match_id: str = "match_id",
    confidence: str = "match_confidence",
) -> DataFrame:
    """Each left row with the id and score of its best right row, NULL below the threshold.

    Not one-to-one. Very similar names are looked up first; whatever scores at least as much as any
    less similar name could is settled. Only the other profiles are compared at the full tolerance.
    """
    floor = (threshold - 100 * TEAM_WEIGHT) / NAME_WEIGHT / 100
    if floor <= 0:
        raise ValueError("the threshold must exceed the weight of the team, else every pair is a match")
    named = profiles(left, blocks, name, team)
    wanted = keep(named.where(F.col("_name") != "").select(*blocks, "_name", "_team").distinct(), "left")
    offered = keep(
        profiles(right, blocks, name, team)
        .where(F.col("_name") != "")
        .groupBy(*blocks, "_name", "_team")
        .agg(F.min(right_id).alias("_rid")),
        "right",
    )
    if floor >= STRICT_RATIO:
        found = _best(_scored_pairs(wanted, offered, blocks, floor), blocks)
    else:
        close = keep(_best(_scored_pairs(wanted, offered, blocks, STRICT_RATIO), blocks), "close")
        settled = close.where(F.col("_score") >= 100 * (NAME_WEIGHT * STRICT_RATIO + TEAM_WEIGHT))
        open_ones = keep(wanted.join(settled, on=[*blocks, "_name", "_team"], how="left_anti"), "open")
        found = settled
        if not open_ones.isEmpty():
            nearby = offered.join(open_ones.select(*blocks).distinct(), on=blocks, how="left_semi")
            found = settled.unionByName(_best(_scored_pairs(open_ones, nearby, blocks, floor), blocks))
    found = found.where(F.col("_score") >= threshold)
    joined = named.join(keep(found, "matches"), on=[*blocks, "_name", "_team"], how="left")
    return joined.select(*left.columns, F.col("_rid").alias(match_id), F.col("_score").alias(confidence))


def enrich(
    matched: DataFrame,
    right: DataFrame,
    blocks: list[str],
    right_id: str,
    match_id: str = "match_id",
    set_columns: dict[str, str] | None = None,
    fill_columns: dict[str, str] | None = None,
) -> DataFrame:
    """Take columns of the matched right row: set them, or fill them only where they are NULL."""
    set_columns = {k: c for k, c in (set_columns or {}).items() if c in right.columns}
    fill_columns = {k: c for k, c in (fill_columns or {}).items() if c in right.columns and k in matched.columns}
    taken = sorted({*set_columns.values(), *fill_columns.values()})
    source = right.select(*blocks, F.col(right_id).alias(match_id), *[F.col(c).alias(f"_r_{c}") for c in taken])
    joined = matched.join(source, on=[*blocks, match_id], how="left")
    values = {out: F.col(f"_r_{c}") for out, c in set_columns.items()}
    values |= {out: F.coalesce(F.col(out), F.col(f"_r_{c}")) for out, c in fill_columns.items()}
    kept = [c for c in matched.columns if c not in set_columns]
    shown = [values.get(c, F.col(c)).alias(c) for c in kept if c != match_id]
    return joined.select(*shown, *[values[c].alias(c) for c in set_columns])


# Columns the market and the expected-goals source add, and those they fill.
MARKET_SET = {"market_value_eur": "market_value_eur"}
EXPECTED_SET = {
    "xg_chain": "xg_chain", "xg_buildup": "xg_buildup", "understat_xg_overperformance": "xg_overperformance",
    "understat_xa_overperformance": "xa_overperformance", "us_xg_per90": "xg_per90", "us_xa_per90": "xa_per90",
    "us_npxg_per90": "npxg_per90", "us_key_passes": "key_passes", "us_shots": "shots",
}
EXPECTED_FILL = {"xg": "xg", "npxg": "npxg", "xg_assist": "xa"}


def match_sources(
    base: DataFrame,
    market: DataFrame,
    expected: DataFrame,
    threshold: float = 80.0,
    blocks: tuple[str, ...] = ("league", "season"),
    row_id: str = "player_id",
) -> DataFrame:
    """Base rows with market value, expected-goals columns and both confidences. Keeps every base row."""
    keys = list(blocks)
    valued = best_match(base, market, keys, row_id, threshold=threshold, confidence="match_confidence_tm")
    valued = enrich(valued, market, keys, row_id, set_columns=MARKET_SET)
    rated = best_match(valued, expected, keys, row_id, threshold=threshold, confidence="match_confidence_us")
    return enrich(rated, expected, keys, row_id, set_columns=EXPECTED_SET, fill_columns=EXPECTED_FILL)


def match_report(matched: DataFrame, confidences: list[str]) -> DataFrame:
    """Rows, matches and mean confidence per source."""
    return matched.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count(c).alias(f"{c}_matched") for c in confidences],
        *[F.avg(c).alias(f"{c}_mean") for c in confidences],
    )
