"""Scans, cleaning, rates, peers, history, imputation and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import E_SQL, TIERED_SQL, entity_periods, query, read, tiered_periods
from tidemark.functions import scalar
from tidemark.operators import clean, features, select
from tidemark.shared import keep
from tidemark.sources import tables

PEERS = ["nation", "segment", "period"]


def kept_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in table as a written one, for operators that read it more than once."""
    return keep(entity_periods(spark, sf_dir), "periods")


@query(
    "scan_filter",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    ints="o_orderkey o_custkey",
    doubles="o_totalprice",
)
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan(
        spark, f"{sf_dir}/orders.parquet", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None}
    )


@query(
    "sql_params",
    """SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders
       WHERE o_totalprice >= 100000 AND o_orderstatus = 'O' GROUP BY o_orderpriority""",
    texts="o_orderpriority",
    ints="n",
    doubles="total",
)
def sql_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sql(
        spark,
        "SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM {orders} "
        "WHERE o_totalprice >= :least AND o_orderstatus = :status GROUP BY o_orderpriority",
        {"least": 100000, "status": "O"},
        orders=read(spark, sf_dir, "orders"),
    )


@query(
    "eligible_rows",
    f"""SELECT entity, period, segment, orders FROM ({E_SQL}) AS e
        WHERE segment <> 'MACHINERY' AND orders BETWEEN 2 AND 6 AND value >= 300000""",
    texts="segment",
    ints="entity period orders",
)
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.keep_eligible(
        entity_periods(spark, sf_dir), "segment", "orders", "value", "MACHINERY", 300000, 2, 6
    )


@query(
    "category_map",
    """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'low'
                              WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'mid' END AS grp,
              CASE WHEN p_type = 'ECONOMY' THEN 'E' WHEN p_type = 'SMALL' THEN 'S' ELSE p_type END AS code
       FROM part""",
    texts="grp code",
    ints="p_partkey",
)
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.concat(F.col("p_type"), F.lit(" , "), F.col("p_brand"))
    groups = {"ECONOMY": "low", "SMALL": "low", "STANDARD": "mid", "MEDIUM": "mid"}
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        scalar.position_group(listed, groups).alias("grp"),
        scalar.short_code(F.col("p_type"), {"ECONOMY": "E", "SMALL": "S"}).alias("code"),
    )


@query(
    "unmapped_dropped",
    """SELECT p_type, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'STANDARD') GROUP BY p_type""",
    texts="p_type",
    ints="n",
)
def unmapped_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"ECONOMY": "a", "SMALL": "b", "STANDARD": "c"}
    mapped = read(spark, sf_dir, "part").withColumn("grp", scalar.mapping(known, F.col("p_type")))
    return mapped.where(F.col("grp").isNotNull()).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "one_hot",
    """SELECT event_id, CAST(event_type = 'click' AS INT) AS is_click, CAST(event_type = 'view' AS INT) AS is_view,
              CAST(event_type = 'error' AS INT) AS is_error FROM events""",
    ints="event_id is_click is_view is_error",
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"is_click": "click", "is_view": "view", "is_error": "error"}
    return features.one_hot(read(spark, sf_dir, "events"), "event_type", names)


@query(
    "unit_rates",
    f"""SELECT entity, period, value / orders AS value_per_order, quantity / orders AS quantity_per_order,
               returned / orders AS returned_per_order FROM ({E_SQL}) AS e WHERE orders >= 2""",
    ints="entity period",
    doubles="value_per_order quantity_per_order returned_per_order",
)
def unit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_rates(
        entity_periods(spark, sf_dir), ["value", "quantity", "returned"], "orders", "_per_order", 2
    )


@query(
    "derived_ratios",
    f"""SELECT entity, period, value / (quantity + 1e-6) AS unit_price, returned / nullif(urgent, 0) AS per_urgent,
               finished / nullif(orders, 0) AS finish_ratio, (27 - orders) / 10 AS room, value / 3060 AS value_share
        FROM ({E_SQL}) AS e""",
    ints="entity period",
    doubles="unit_price per_urgent finish_ratio room value_share",
)
def derived_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_where_present(
        entity_periods(spark, sf_dir),
        [
            ("unit_price", ["value", "quantity"], scalar.ratio_eps(F.col("value"), F.col("quantity"))),
            ("per_urgent", ["returned", "urgent"], scalar.ratio(F.col("returned"), F.col("urgent"))),
            ("finish_ratio", ["finished", "orders"], scalar.ratio(F.col("finished"), F.col("orders"))),
            ("room", ["orders"], (27 - F.col("orders")) / 10),
            ("value_share", ["value"], F.col("value") / 3060),
            ("never", ["no_such_column"], F.lit(1)),
        ],
    )


@query(
    "interactions",
    f"""SELECT entity, period, room * growth AS room_x_growth, room * value_share AS room_x_share,
               is_machinery * value_share AS machinery_share
        FROM (SELECT entity, period, (27 - orders) / 10 AS room, value / 3060 AS value_share,
                     CAST(segment = 'MACHINERY' AS INT) AS is_machinery,
                     (value - lag(value) OVER w) / (abs(lag(value) OVER w) + 0.01) AS growth
              FROM ({E_SQL}) AS e WINDOW w AS (PARTITION BY entity ORDER BY period)) AS f""",
    ints="entity period",
    doubles="room_x_growth room_x_share machinery_share",
)
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = features.one_hot(entity_periods(spark, sf_dir), "segment", {"is_machinery": "MACHINERY"})
    grown = features.add_history(base, "entity", "period", ["orders"], growth={"growth": "value"})
    return features.add_where_present(
        grown,
        [
            ("room", ["orders"], (27 - F.col("orders")) / 10),
            ("value_share", ["value"], F.col("value") / 3060),
            ("room_x_growth", ["room", "growth"], F.col("room") * F.col("growth")),
            ("room_x_share", ["room", "value_share"], F.col("room") * F.col("value_share")),
            ("machinery_share", ["is_machinery", "value_share"], F.col("is_machinery") * F.col("value_share")),
        ],
    )


#: Columns of the entity rows under the names that the fixed formulas read.
_AS_FORMULA_INPUTS = {
    "goals_per90": "quantity", "xg_per90": "value / 1000", "assists_per90": "orders", "xg_assist_per90": "finished",
    "npxg_per90": "urgent", "_coefficient": "orders / 10", "touches_per90": "quantity", "passes_per90": "value / 100",
    "age": "orders", "minutes": "value", "shots_per90": "orders", "goals": "quantity", "games_starts": "finished",
    "games": "orders", "assists": "urgent",
}
_FORMULA_INPUTS_SQL = f"""
    SELECT entity, period, {", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in _AS_FORMULA_INPUTS.items())} FROM ({E_SQL}) AS e
"""
_DERIVED_SQL = f"""
    SELECT *, goals_per90 - xg_per90 AS xg_overperformance, assists_per90 - xg_assist_per90 AS xa_overperformance,
           goals_per90 + assists_per90 AS goal_contribution_per90, npxg_per90 + xg_assist_per90 AS npxg_xa_per90,
           xg_per90 * _coefficient AS league_adjusted_xg, (touches_per90 + passes_per90) / 100 AS involvement_score,
           (27 - age) / 10 AS age_potential_factor, minutes / 3060 AS minutes_share,
           goals_per90 / (shots_per90 + 1e-6) AS shot_conversion_rate, goals / nullif(games_starts, 0) AS goals_per_start,
           assists / nullif(games_starts, 0) AS assists_per_start, games_starts / nullif(games, 0) AS start_ratio,
           (goals_per90 + assists_per90) * _coefficient AS goal_contribution_league_adj
    FROM ({_FORMULA_INPUTS_SQL}) AS inputs
"""


def _with_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = [F.expr(sql).cast("double").alias(name) for name, sql in _AS_FORMULA_INPUTS.items()]
    rows = entity_periods(spark, sf_dir).select("entity", "period", *inputs)
    return features.add_where_present(rows, features.derived_formulas())


@query(
    "derived_features",
    _DERIVED_SQL,
    ints="entity period",
    doubles="xg_overperformance xa_overperformance goal_contribution_per90 npxg_xa_per90 league_adjusted_xg involvement_score"
    " age_potential_factor minutes_share shot_conversion_rate goals_per_start assists_per_start start_ratio goal_contribution_league_adj",
)
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed derived formulas on renamed columns."""
    return _with_derived(spark, sf_dir)


@query(
    "interaction_features",
    f"""SELECT entity, period, age_potential_factor * goal_contribution_per90 AS age_x_goal_contribution,
               shot_conversion_rate * age_potential_factor AS conversion_x_age,
               minutes_share * age_potential_factor AS minutes_share_x_age
        FROM ({_DERIVED_SQL}) AS derived""",
    ints="entity period",
    doubles="age_x_goal_contribution conversion_x_age minutes_share_x_age",
)
def interaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed interaction formulas whose inputs the renamed columns have."""
    return features.add_where_present(_with_derived(spark, sf_dir), features.interaction_formulas())


@query(
    "coef_adjust",
    f"""SELECT entity, period, value * CASE segment WHEN 'BUILDING' THEN 0.85 WHEN 'MACHINERY' THEN 0.7
                                                    WHEN 'HOUSEHOLD' THEN 0.93 ELSE 1.0 END AS value_adj,
               quantity * CASE segment WHEN 'BUILDING' THEN 0.85 WHEN 'MACHINERY' THEN 0.7
                                       WHEN 'HOUSEHOLD' THEN 0.93 ELSE 1.0 END AS quantity_adj
        FROM ({E_SQL}) AS e""",
    ints="entity period",
    doubles="value_adj quantity_adj",
)
def coef_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = {"BUILDING": 0.85, "MACHINERY": 0.7, "HOUSEHOLD": 0.93}
    rows = features.add_coefficient(entity_periods(spark, sf_dir), "segment", table)
    return features.scale_by_coefficient(rows, ["value", "quantity", "absent"], F.col("_coefficient"), "_adj")


@query(
    "cap_outliers",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, least(l_extendedprice, cap_price) AS l_extendedprice,
              least(l_suppkey, CAST(floor(cap_supplier) AS BIGINT)) AS l_suppkey,
              CAST(l_extendedprice > cap_price AS INT) + CAST(l_suppkey > floor(cap_supplier) AS INT) AS capped
       FROM lineitem JOIN (
           SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.99) AS cap_price,
                  quantile_cont(l_suppkey, 0.99) AS cap_supplier FROM lineitem GROUP BY l_returnflag) AS caps
         ON l_returnflag = flag""",
    texts="l_returnflag",
    ints="l_orderkey l_linenumber l_partkey l_suppkey capped",
    doubles="l_extendedprice",
)
def cap_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cap_outliers(
        read(spark, sf_dir, "lineitem"), "l_returnflag", ["l_extendedprice", "l_suppkey"], 0.99, "capped"
    )


@query(
    "peer_baseline",
    f"""SELECT entity, period, value - avg(value) OVER w AS value_above_avg,
               quantity - avg(quantity) OVER w AS quantity_above_avg
        FROM ({E_SQL}) AS e WINDOW w AS (PARTITION BY nation, segment, period)""",
    ints="entity period",
    doubles="value_above_avg quantity_above_avg",
)
def peer_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = {"value_above_avg": "value", "quantity_above_avg": "quantity"}
    return features.add_peer_deviation(kept_periods(spark, sf_dir), PEERS, outputs)


@query(
    "naive_expected",
    f"""SELECT entity, period, orders * rate AS expected, value - orders * rate AS residual
        FROM (SELECT *, avg(value) OVER w / (avg(orders) OVER w + 1e-6) AS rate
              FROM ({E_SQL}) AS e WINDOW w AS (PARTITION BY nation, segment, period)) AS r""",
    ints="entity period",
    doubles="expected residual",
)
def naive_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_expected(kept_periods(spark, sf_dir), PEERS, "value", "orders", "expected", "residual")


@query(
    "yoy_growth",
    f"""SELECT entity, period, (value - lag(value) OVER w) / (abs(lag(value) OVER w) + 0.01) AS value_growth,
               (quantity - lag(quantity) OVER w) / (abs(lag(quantity) OVER w) + 0.01) AS quantity_growth
        FROM ({E_SQL}) AS e WINDOW w AS (PARTITION BY entity ORDER BY period)""",
    ints="entity period",
    doubles="value_growth quantity_growth",
)
def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    growth = {"value_growth": "value", "quantity_growth": "quantity"}
    return features.add_history(kept_periods(spark, sf_dir), "entity", "period", ["orders"], growth=growth)


@query(
    "growth_across_tiers",
    f"""SELECT entity, period, tier, (value - lag(value) OVER w) / (abs(lag(value) OVER w) + 0.01) AS value_growth
        FROM ({TIERED_SQL}) AS t WINDOW w AS (PARTITION BY entity ORDER BY period, tier)""",
    texts="tier",
    ints="entity period",
    doubles="value_growth",
)
def growth_across_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows per entity and period: the previous row is the previous tier or year."""
    rows = tiered_periods(spark, sf_dir)
    return features.add_history(rows, "entity", "period", ["tier"], growth={"value_growth": "value"})


@query(
    "expanding_stats",
    f"""SELECT entity, period, count(*) OVER upto AS seen,
               CASE WHEN count(*) OVER whole > 1 THEN avg(value) OVER upto END AS mean_value,
               CASE WHEN count(*) OVER whole > 1 THEN max(value) OVER upto END AS max_value,
               CASE WHEN count(*) OVER whole > 1 THEN avg(returned) OVER upto END AS mean_returned
        FROM ({E_SQL}) AS e
        WINDOW upto AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING),
               whole AS (PARTITION BY entity)""",
    ints="entity period seen",
    doubles="mean_value max_value mean_returned",
)
def expanding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = {"mean_value": ("mean", "value"), "max_value": ("max", "value"), "mean_returned": ("mean", "returned")}
    return features.add_history(
        kept_periods(spark, sf_dir), "entity", "period", ["orders"], history=history, count_name="seen"
    )


@query(
    "expanding_slope",
    f"""SELECT entity, tier, period,
               CASE WHEN rn >= 2 THEN regr_slope(value, rn) OVER upto END AS value_trend,
               CASE WHEN rn >= 2 THEN regr_slope(orders, rn) OVER upto END AS orders_trend
        FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period, tier) AS rn
              FROM ({TIERED_SQL}) AS t) AS numbered
        WINDOW upto AS (PARTITION BY entity ORDER BY rn ROWS UNBOUNDED PRECEDING)""",
    texts="tier",
    ints="entity period",
    doubles="value_trend orders_trend",
)
def expanding_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = {"value_trend": ("slope", "value"), "orders_trend": ("slope", "orders")}
    return features.add_history(tiered_periods(spark, sf_dir), "entity", "period", ["tier"], history=history)


@query(
    "impute_group_median",
    f"""WITH e AS ({E_SQL}),
        g AS (SELECT entity, period, coalesce(returned, median(returned) OVER w) AS returned,
                     coalesce(quantity, median(quantity) OVER w) AS quantity
              FROM e WINDOW w AS (PARTITION BY nation, segment, period))
        SELECT entity, period, coalesce(returned, (SELECT median(returned) FROM g)) AS returned,
               coalesce(quantity, (SELECT median(quantity) FROM g)) AS quantity FROM g""",
    ints="entity period",
    doubles="returned quantity",
)
def impute_group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.impute_group_median(kept_periods(spark, sf_dir), PEERS, ["returned", "quantity"])


@query(
    "variance_filter",
    f"""SELECT feature, variance, coalesce(variance < 5000, true) AS dropped FROM (
            SELECT 'orders' AS feature, var_samp(orders) AS variance FROM ({E_SQL}) AS e
            UNION ALL SELECT 'value_k', var_samp(value / 1000) FROM ({E_SQL}) AS e
            UNION ALL SELECT 'quantity', var_samp(quantity) FROM ({E_SQL}) AS e
            UNION ALL SELECT 'returned', var_samp(returned) FROM ({E_SQL}) AS e
            UNION ALL SELECT 'finished', var_samp(finished) FROM ({E_SQL}) AS e) AS v""",
    texts="feature dropped",
    doubles="variance",
)
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["orders", "value_k", "quantity", "returned", "finished"]
    scaled = entity_periods(spark, sf_dir).withColumn("value_k", F.col("value") / 1000)
    rows = select.variance_table(scaled, columns)
    return rows.withColumn("dropped", F.coalesce(F.col("variance") < 5000, F.lit(True)))


_PAIRS = [
    ("orders", "value"),
    ("orders", "finished"),
    ("value", "finished"),
    ("orders", "urgent"),
    ("value", "urgent"),
    ("finished", "urgent"),
]


@query(
    "correlation_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM ({E_SQL}) AS e" for a, b in _PAIRS
    ),
    texts="a b",
    doubles="r",
)
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["orders", "value", "finished", "urgent"]
    return select.correlation_table(kept_periods(spark, sf_dir), columns)


@query(
    "train_median_fill",
    f"""WITH e AS ({E_SQL})
        SELECT entity, period, coalesce(returned, (SELECT median(returned) FROM e WHERE period <= 1997)) AS returned,
               coalesce(quantity, (SELECT median(quantity) FROM e WHERE period <= 1997)) AS quantity FROM e""",
    ints="entity period",
    doubles="returned quantity",
)
def train_median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_periods(spark, sf_dir)
    medians = select.fit_medians(rows.where(F.col("period") <= 1997), ["returned", "quantity"])
    return select.apply_medians(rows, medians)


@query(
    "scalar_misc",
    f"""SELECT entity, period, lower(replace(segment, ' ', '-')) AS slug, period - 1960 AS age,
               greatest(least(value / 99991, 2.0), 0.5) AS clipped, round(value / 7, 2) AS rounded,
               coalesce(TRY_CAST(segment AS INT), -1) AS cast_default
        FROM ({E_SQL}) AS e""",
    texts="slug",
    ints="entity period age cast_default",
    doubles="clipped rounded",
)
def scalar_misc(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.concat(F.col("period"), F.lit("-"), F.substring((F.col("period") + 1).cast("string"), 3, 2))
    return entity_periods(spark, sf_dir).select(
        "entity",
        "period",
        scalar.slug(F.col("segment")).alias("slug"),
        scalar.age_at(short, F.lit(1960)).alias("age"),
        scalar.clip(F.col("value") / 99991, 0.5, 2.0).alias("clipped"),
        F.round(F.col("value") / 7, 2).alias("rounded"),
        scalar.safe_cast(F.col("segment"), "int", -1).alias("cast_default"),
    )


@query(
    "peer_leaders",
    f"""SELECT entity, period, name, nation, segment, value_per_order, above FROM (
            SELECT *, value_per_order - avg(value_per_order) OVER (PARTITION BY nation, segment, period) AS above
            FROM (SELECT *, value / orders AS value_per_order FROM ({E_SQL}) AS e WHERE orders >= 2) AS r) AS d
        ORDER BY above DESC, entity, period LIMIT 20""",
    texts="name segment",
    ints="entity period nation",
    doubles="value_per_order above",
)
def peer_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entities beat their peers most in a period?"""
    rated = features.add_rates(kept_periods(spark, sf_dir), ["value"], "orders", "_per_order", 2)
    compared = features.add_peer_deviation(rated, PEERS, {"above": "value_per_order"})
    return compared.orderBy(F.col("above").desc(), "entity", "period").limit(20)
