"""Fixed values of the default profile: groups, coefficients, column lists, model parameters.

Everything here is data. The operators take these as parameters and know nothing of the domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import mapping

# Position texts of the market source and their group.
MARKET_POSITIONS = {
    "Centre-Forward": "FW", "Left Winger": "FW", "Right Winger": "FW", "Second Striker": "FW", "Striker": "FW",
    "Central Midfield": "MF", "Attacking Midfield": "MF", "Defensive Midfield": "MF",
    "Left Midfield": "MF", "Right Midfield": "MF",
    "Centre-Back": "DF", "Left-Back": "DF", "Right-Back": "DF",
    "Goalkeeper": "GK",
}
# The listing page accepts these texts as a position.
LISTED_POSITIONS = [
    "Centre-Forward", "Left Winger", "Right Winger", "Second Striker", "Attacking Midfield", "Central Midfield",
    "Defensive Midfield", "Left Midfield", "Right Midfield", "Centre-Back", "Left-Back", "Right-Back", "Goalkeeper",
]
# Group codes, and the short codes of the expected-goals source.
GROUP_CODES = {"FW": "FW", "MF": "MF", "DF": "DF", "GK": "GK"}
SHORT_CODES = {"F": "FW", "M": "MF", "D": "DF", "GK": "GK", "S": "FW"}

# Target tier with coefficient.
TARGET_LEAGUES = {
    "Premier League": 1.00, "La Liga": 0.95, "Bundesliga": 0.93, "Serie A": 0.90, "Ligue 1": 0.85,
}
# Source tier with coefficient and priority.
SOURCE_LEAGUES = {
    "Eredivisie": (0.85, 1), "Primeira Liga": (0.82, 1), "Belgian Pro League": (0.75, 1), "Championship": (0.78, 1),
    "Serie B": (0.72, 2), "Ligue 2": (0.70, 2), "Austrian Bundesliga": (0.68, 2), "Scottish Premiership": (0.65, 2),
}

# Label window and row filters.
LOOKFORWARD_YEARS = 3
MIN_TARGET_MINUTES = 900
MIN_MINUTES, MIN_AGE, MAX_AGE = 450, 17, 26
MIN_UNITS = 0.5

# Walk-forward folds as (fold, last training year, validation year, test year).
FOLDS = [(1, 2017, 2018, 2019), (2, 2018, 2019, 2020), (3, 2019, 2020, 2021)]

# Counts that become rates per 90 minutes.
RATE_COLUMNS = [
    "goals", "assists", "xg", "npxg", "xg_assist", "shots", "shots_on_target", "passes_completed", "passes",
    "progressive_passes", "progressive_carries", "tackles", "tackles_won", "interceptions", "blocks", "clearances",
    "touches", "take_ons_won", "carries", "carries_into_final_third", "carries_into_penalty_area",
    "touches_att_pen_area", "assisted_shots",
]
# Rates that are scaled by the league coefficient.
ADJUSTED_COLUMNS = [
    "goals_per90", "assists_per90", "xg_per90", "npxg_per90", "xg_assist_per90", "shots_per90",
    "shots_on_target_per90", "passes_completed_per90", "passes_per90", "progressive_passes_per90",
    "assisted_shots_per90", "carries_into_final_third_per90", "carries_into_penalty_area_per90",
    "touches_att_pen_area_per90", "us_xg_per90", "us_xa_per90", "us_npxg_per90", "naive_xg_per90",
    "non_penalty_goals_per90", "goal_contribution_per90",
]
# Growth metric and the column it reads; history statistics as (kind, column).
GROWTH_METRICS = {
    "xg_per90": "xg_per90", "xa_per90": "xg_assist_per90", "progressive_passes_per90": "progressive_passes_per90",
    "progressive_carries_per90": "progressive_carries_per90", "minutes_played": "minutes",
}
GROWTH_EPSILON = 0.01
HISTORY = {
    "career_avg_goals_per90": ("mean", "goals_per90"),
    "career_avg_assists_per90": ("mean", "assists_per90"),
    "career_max_goals_per90": ("max", "goals_per90"),
    "career_avg_minutes": ("mean", "minutes"),
    "goals_trend": ("slope", "goals_per90"),
    "minutes_trend": ("slope", "minutes"),
}

# Columns that are never capped, never pruned, never model inputs.
UNCAPPED = [
    "age", "birth_year", "games", "games_starts", "minutes", "pens_made", "pens_att", "cards_yellow", "cards_red",
]
PROTECTED = [
    "player_id", "name", "team", "league", "season", "position", "position_group", "nationality", "source",
    "scraped_at", "label", "breakout_league", "breakout_season", "age", "birth_year", "match_confidence_tm",
    "match_confidence_us", "market_value_eur",
]
CORRELATION_LIMIT = 0.90
VARIANCE_LIMIT = 0.0001

# Profile features per group, main list then second list.
PROFILE_FEATURES = {
    "FW": [
        "xg_per90", "npxg_per90", "shots_per90", "shots_on_target_pct", "touches_in_box_per90",
        "successful_dribbles_per90", "xg_overperformance", "xa_per90", "key_passes_per90",
    ],
    "MF": [
        "progressive_passes_per90", "progressive_carries_per90", "key_passes_per90", "pass_completion_pct",
        "xa_per90", "tackles_per90", "interceptions_per90", "xg_per90",
    ],
    "DF": [
        "tackles_per90", "interceptions_per90", "blocks_per90", "clearances_per90", "aerials_won_pct",
        "progressive_passes_per90", "pass_completion_pct",
    ],
}

# Model parameters.
SEED = 42
K_VALUES = [10, 20, 50, 100]
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
BLEND_WEIGHTS = (0.5, 0.5)
SEARCH_TRIALS = 100
# Verdict limits on ROC-AUC.
VERDICTS = [(0.75, "STRONG"), (0.65, "MODERATE")]
WEAK_VERDICT = "WEAK"


def league_coefficients() -> dict[str, float]:
    """Coefficient by display name and by slug."""
    named = {**{name: pair[0] for name, pair in SOURCE_LEAGUES.items()}, **TARGET_LEAGUES}
    return {**named, **{name.lower().replace(" ", "-"): value for name, value in named.items()}}


def coefficient(league: Column, table: dict[str, float] | None = None, default: float = 1.0) -> Column:
    """Looked-up coefficient as an expression, unknown leagues get the default."""
    return mapping(table or league_coefficients(), league, F.lit(default))


def league_table(spark: SparkSession) -> DataFrame:
    """The league settings as a small table: name, slug, tier, coefficient, priority."""
    rows = [(n, "target", c, None) for n, c in TARGET_LEAGUES.items()]
    rows += [(n, "source", c, p) for n, (c, p) in SOURCE_LEAGUES.items()]
    table = spark.createDataFrame(rows, "name string, tier string, coefficient double, priority int")
    return table.withColumn("slug", F.replace(F.lower("name"), F.lit(" "), F.lit("-")))


def league_names(tier: str) -> list[str]:
    """All spellings of the leagues of a tier, so that either form in the data is met."""
    names = list(TARGET_LEAGUES if tier == "target" else SOURCE_LEAGUES)
    return names + [n.lower().replace(" ", "-") for n in names]
