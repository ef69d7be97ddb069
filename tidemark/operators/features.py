"""Rates, ratios, peer baselines, growth, history and interactions of entity-period rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import all_of, ratio, ratio_eps
from tidemark.operators.order_stats import tie_cell
from tidemark.shared import attach
from tidemark.sources import config

PEERS = ["league", "position_group", "season"]


def add_rates(
    df: DataFrame,
    columns: list[str] | None = None,
    exposure: str = "minutes_90s",
    suffix: str = "_per90",
    min_exposure: float = config.MIN_UNITS,
) -> DataFrame:
    """Counts per unit of exposure; rows with too little exposure are dropped."""
    present = [c for c in (columns or config.RATE_COLUMNS) if c in df.columns]
    kept = df.where(F.col(exposure) >= min_exposure)
    return kept.withColumns({f"{c}{suffix}": F.try_divide(F.col(c), F.col(exposure)) for c in present})


def add_coefficient(df: DataFrame, league: str = "league", table: dict | None = None) -> DataFrame:
    """The league coefficient as a column, looked up once for all features that use it."""
    return df.withColumn("_coefficient", config.coefficient(F.col(league), table))


def scale_by_coefficient(
    df: DataFrame, columns: list[str], coefficient: Column, suffix: str = "_league_adj"
) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({f"{c}{suffix}": F.col(c) * coefficient for c in present})


def one_hot(df: DataFrame, category: str, names: dict[str, str]) -> DataFrame:
    """0/1 column per listed value; a missing category is 0 everywhere."""
    return df.withColumns({n: F.coalesce((F.col(category) == v).cast("int"), F.lit(0)) for n, v in names.items()})


def add_where_present(df: DataFrame, formulas: list[tuple[str, list[str], Column]]) -> DataFrame:
    """Add each formula whose input columns all exist; later formulas may use earlier results.

    Formulas that do not depend on each other share one projection.
    """
    known, batch = set(df.columns), {}
    for name, inputs, expression in formulas:
        if not known.issuperset(inputs):
            continue
        if batch.keys() & set(inputs):
            df, batch = df.withColumns(batch), {}
        batch[name] = expression
        known.add(name)
    return df.withColumns(batch) if batch else df


def _product(a: str, b: str) -> Column:
    return F.col(a) * F.col(b)


def _formula(name: str, inputs: str, build) -> tuple[str, list[str], Column]:
    names = inputs.split()
    return name, names, build(*[F.col(n) for n in names])


def derived_formulas() -> list[tuple[str, list[str], Column]]:
    """Name, inputs and expression of each derived column that needs no peer group."""
    return [
        _formula("xg_overperformance", "goals_per90 xg_per90", lambda g, x: g - x),
        _formula("xa_overperformance", "assists_per90 xg_assist_per90", lambda a, x: a - x),
        _formula("goal_contribution_per90", "goals_per90 assists_per90", lambda g, a: g + a),
        _formula("npxg_xa_per90", "npxg_per90 xg_assist_per90", lambda n, x: n + x),
        _formula("league_adjusted_xg", "xg_per90 _coefficient", lambda x, k: x * k),
        _formula("involvement_score", "touches_per90 passes_per90", lambda t, p: (t + p) / 100),
        _formula("age_potential_factor", "age", lambda age: (27 - age) / 10),
        _formula("minutes_share", "minutes", lambda m: m / 3060),
        _formula("us_xg_overperformance", "goals_per90 us_xg_per90", lambda g, x: g - x),
        _formula("us_npxg_xa_per90", "us_npxg_per90 us_xa_per90", lambda n, x: n + x),
        _formula("shot_conversion_rate", "goals_per90 shots_per90", ratio_eps),
        _formula("sot_rate_per90", "shots_on_target_per90 shots_per90", ratio_eps),
        _formula("goals_per_start", "goals games_starts", ratio),
        _formula("assists_per_start", "assists games_starts", ratio),
        _formula("start_ratio", "games_starts games", ratio),
        _formula("goal_contribution_league_adj", "goal_contribution_per90 _coefficient", lambda g, k: g * k),
    ]


def _independent_rates(df: DataFrame) -> DataFrame:
    """Two rates with fallbacks that depend on the columns at hand."""
    have = set(df.columns)
    added = {}
    if {"goals", "pens_made", "minutes_90s"} <= have:
        open_play = F.col("goals") - F.coalesce(F.col("pens_made"), F.lit(0))
        added["non_penalty_goals_per90"] = F.try_divide(open_play, F.col("minutes_90s"))
    elif "goals_per90" in have:
        added["non_penalty_goals_per90"] = F.col("goals_per90")
    if "interceptions_per90" in have:
        if "tackles_won_per90" in have:
            won = F.col("tackles_won_per90")
        elif "tackles_won" in have:
            won = F.try_divide(F.col("tackles_won"), F.col("minutes_90s"))
        else:
            won = F.col("tackles_per90") if "tackles_per90" in have else None
        if won is not None:
            added["defensive_actions_per90"] = won + F.col("interceptions_per90")
    return df.withColumns(added) if added else df


def peer_means(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean of each column per peer group; rows with a missing key form no group."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])


def add_peer_deviation(df: DataFrame, keys: list[str], outputs: dict[str, str]) -> DataFrame:
    """Value minus peer mean for each ``output: column``.

    The means are combined on the map side and joined back, so that a peer group with a third of all
    rows is never sorted or held in one task.
    """
    columns = sorted(set(outputs.values()))
    joined = attach(df, peer_means(df, keys, columns), keys)
    deviations = {out: F.col(c) - F.col(f"_mean_{c}") for out, c in outputs.items()}
    return joined.withColumns(deviations).drop(*[f"_mean_{c}" for c in columns])


def add_expected(
    df: DataFrame, keys: list[str], actual: str, volume: str, expected: str, residual: str
) -> DataFrame:
    """Expected value from the peer ratio of means, and actual minus expected."""
    joined = attach(df, peer_means(df, keys, [actual, volume]), keys)
    rate = ratio_eps(F.col(f"_mean_{actual}"), F.col(f"_mean_{volume}"))
    return (
        joined.withColumn(expected, F.col(volume) * rate)
        .withColumn(residual, F.col(actual) - F.col(expected))
        .drop(f"_mean_{actual}", f"_mean_{volume}")
    )


def add_baselines(df: DataFrame, keys: list[str] = PEERS) -> DataFrame:
    """All peer comparisons of the default profile with one aggregate and one join."""
    if not set(keys) <= set(df.columns):
        return df
    rated = _independent_rates(df)
    wanted = [c for c in ("goals_per90", "assists_per90", "shots_on_target_per90", "shots_per90") if c in rated.columns]
    if not wanted:
        return rated
    joined = attach(rated, peer_means(rated, keys, wanted), keys)
    formulas = [
        _formula(
            "naive_xg_per90", "shots_per90 _mean_goals_per90 _mean_shots_per90", lambda s, g, m: s * ratio_eps(g, m)
        ),
        _formula("finishing_skill", "goals_per90 naive_xg_per90", lambda g, n: g - n),
        _formula("goals_above_avg", "goals_per90 _mean_goals_per90", lambda v, m: v - m),
        _formula("assists_above_avg", "assists_per90 _mean_assists_per90", lambda v, m: v - m),
        _formula("shot_volume_above_avg", "shots_on_target_per90 _mean_shots_on_target_per90", lambda v, m: v - m),
    ]
    return add_where_present(joined, formulas).drop(*[f"_mean_{c}" for c in wanted])


def add_derived(df: DataFrame) -> DataFrame:
    """Derived ratios, one-hot groups, peer baselines and group-gated features."""
    flagged = add_where_present(df if "_coefficient" in df.columns else add_coefficient(df), derived_formulas())
    if "position_group" in flagged.columns:
        flagged = one_hot(flagged, "position_group", {"is_forward": "FW", "is_midfielder": "MF", "is_defender": "DF"})
    gated = [
        ("fw_goals_above_avg", ["is_forward", "goals_above_avg"]),
        ("mf_assists_above_avg", ["is_midfielder", "assists_per90"]),
        ("df_defensive_actions", ["is_defender", "defensive_actions_per90"]),
    ]
    return add_where_present(add_baselines(flagged), [(n, pair, _product(*pair)) for n, pair in gated])


def interaction_formulas() -> list[tuple[str, list[str], Column]]:
    pairs = {
        "age_x_minutes_growth": ("age_potential_factor", "minutes_played_growth"),
        "goals_above_avg_x_league_coeff": ("goals_above_avg", "_coefficient"),
        "finishing_x_volume": ("finishing_skill", "shots_per90"),
        "proxy_xg_x_age": ("proxy_xg_per90", "age_potential_factor"),
        "defensive_x_progressive": ("defensive_actions_per90", "progressive_carries_per90"),
        "age_x_goal_contribution": ("age_potential_factor", "goal_contribution_per90"),
        "conversion_x_age": ("shot_conversion_rate", "age_potential_factor"),
        "starter_x_goals_above_avg": ("start_ratio", "goals_above_avg"),
        "minutes_share_x_age": ("minutes_share", "age_potential_factor"),
    }
    return [(name, list(pair), _product(*pair)) for name, pair in pairs.items()]


def add_history(
    df: DataFrame,
    entity: str,
    period: str,
    tie: list[str],
    growth: dict[str, str] | None = None,
    history: dict[str, tuple[str, str]] | None = None,
    count_name: str | None = None,
    epsilon: float = config.GROWTH_EPSILON,
    strict: bool = False,
) -> DataFrame:
    """Growth against the previous row and expanding statistics, row by row in (period, tie) order.

    ``growth`` maps an output to a column: (now - before) / (abs(before) + epsilon). ``history`` maps
    an output to ('mean' | 'max' | 'slope', column) over all rows up to this one. An entity with a
    single row has NULL history; ``strict`` also leaves the first row of every entity NULL, so that
    no later row decides what an earlier one shows.

    Rows are sorted only within a segment: entity, period and cell of the first tie column. Each
    segment is summed, the sums run forward over the segments of the entity, and what lies before a
    segment is added to its rows. No task sorts all rows of an entity, however many it has.
    """
    growth, history = growth or {}, history or {}
    segment = [entity, period, "_cell"]
    used = sorted({*growth.values(), *[c for _, c in history.values()]})
    inside = Window.partitionBy(*segment).orderBy(*tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_cell", tie_cell(df, tie[0])).withColumn("_i", F.row_number().over(inside) - 1)

    def sums(c: str) -> dict[str, Column]:
        value = F.col(c).cast("double")
        return {
            f"_n_{c}": F.count(value),
            f"_s_{c}": F.sum(value),
            f"_x_{c}": F.sum(F.col("_i") * value),
            f"_m_{c}": F.max(value),
        }

    last = F.max_by(F.struct(*[F.col(c).alias(c) for c in used]), F.col("_i")).alias("_last")
    totals = [expr.alias(name) for c in used for name, expr in sums(c).items()]
    segments = rows.groupBy(*segment).agg(F.count(F.lit(1)).alias("_rows"), last, *totals)

    by_segment = Window.partitionBy(entity).orderBy(period, "_cell")
    earlier = by_segment.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    located = segments.withColumns(
        {
            "_off": F.coalesce(F.sum("_rows").over(earlier), zero),
            "_all": F.sum("_rows").over(Window.partitionBy(entity)),
        }
    )
    before = [F.lag("_last").over(by_segment).alias("_prev"), F.col("_off"), F.col("_all")]
    for c in used:
        before += [
            F.coalesce(F.sum(f"_n_{c}").over(earlier), zero).alias(f"_bn_{c}"),
            F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0.0)).alias(f"_bs_{c}"),
            F.coalesce(F.sum(F.col(f"_x_{c}") + F.col("_off") * F.col(f"_s_{c}")).over(earlier), F.lit(0.0)).alias(
                f"_bx_{c}"
            ),
            F.max(f"_m_{c}").over(earlier).alias(f"_bm_{c}"),
        ]
    placed = located.select(*[F.col(c).alias(f"_of_{c}") for c in segment], *before)
    same = [F.col(entity) == F.col(f"_of_{entity}"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in segment[1:]]]
    joined = rows.join(placed, on=all_of(same), how="left")
    joined = joined.withColumn("_n", F.col("_off") + F.col("_i") + 1)

    shown = F.col(entity).isNotNull() & (F.col("_n" if strict else "_all") > 1)
    outputs = {}
    if count_name:
        outputs[count_name] = F.when(F.col(entity).isNotNull(), F.col("_n"))
    for name, c in growth.items():
        previous = F.when(F.col("_i") == 0, F.col(f"_prev.{c}")).otherwise(F.lag(c).over(inside)).cast("double")
        outputs[name] = F.when(
            F.col(entity).isNotNull(), (F.col(c) - previous) / (F.abs(previous) + F.lit(epsilon))
        )
    for name, (kind, c) in history.items():
        value = F.col(c).cast("double")
        seen = F.col(f"_bn_{c}") + F.count(value).over(upto)
        total = F.col(f"_bs_{c}") + F.coalesce(F.sum(value).over(upto), F.lit(0.0))
        if kind == "mean":
            result = F.when(seen > 0, F.try_divide(total, seen))
        elif kind == "max":
            result = F.greatest(F.col(f"_bm_{c}"), F.max(value).over(upto))
        else:
            n = F.col("_n").cast("double")
            position = F.col("_off") + F.col("_i")
            weighted = F.col(f"_bx_{c}") + F.coalesce(F.sum(position * value).over(upto), F.lit(0.0))
            # Positions run 0 .. n-1 with mean (n-1)/2 and sum of squared deviations n(n^2-1)/12.
            top = weighted - (n - 1) / 2 * total
            result = F.when((n >= 2) & (seen == n), F.try_divide(top, n * (n * n - 1) / 12))
        outputs[name] = F.when(shown, result)
    final = joined.withColumns(outputs)
    return final.select(*df.columns, *outputs)


def engineer(
    df: DataFrame, entity: str = "player_id", period: str = "season", strict: bool = False, before_interactions=None
) -> DataFrame:
    """Rates, derived and peer features, growth, history, interactions, league scaling.

    ``before_interactions`` is a function on the frame, for a model whose output the interactions use.
    """
    rated = add_derived(add_coefficient(add_rates(df)))
    have = set(rated.columns)
    dated = add_history(
        rated,
        entity,
        period,
        ["league"],
        growth={f"{name}_growth": c for name, c in config.GROWTH_METRICS.items() if c in have},
        history={name: spec for name, spec in config.HISTORY.items() if spec[1] in have},
        count_name="career_seasons",
        strict=strict,
    )
    ready = before_interactions(dated) if before_interactions else dated
    combined = add_where_present(ready, interaction_formulas())
    return scale_by_coefficient(combined, config.ADJUSTED_COLUMNS, F.col("_coefficient")).drop("_coefficient")


def feature_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in, rows out, columns added."""
    rows_in = before.agg(F.count(F.lit(1)).alias("input_rows"))
    added = len(set(after.columns) - set(before.columns))
    return after.agg(F.count(F.lit(1)).alias("output_rows")).select(
        rows_in.scalar().alias("input_rows"), "output_rows", F.lit(added).alias("features_created")
    )
