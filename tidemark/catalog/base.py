"""Registry of runnable queries and the stand-in tables they share.

The driver tables stand in for entity-period rows: a customer per order year is an entity per period,
nation and market segment are its peer group, order priority is its tier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.label import forward_label
from tidemark.shared import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 4
TARGETS = ["1-URGENT", "2-HIGH"]
SOURCES = ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MIN_ORDERS = 2
FOLDS = [(1, 1995, 1996, 1997), (2, 1996, 1997, 1998), (3, 1997, 1998, 1999)]


def tidy(df: DataFrame, texts: str = "", ints: str = "", doubles: str = "") -> DataFrame:
    """Result columns in a form both engines print alike: long integers, rounded doubles, text."""
    return df.select(
        *texts.split(),
        *[F.col(c).cast("long").alias(c) for c in ints.split()],
        *[(F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0)).alias(c) for c in doubles.split()],
    )


def tidy_sql(sql: str, texts: str = "", ints: str = "", doubles: str = "") -> str:
    columns = texts.split()
    columns += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    columns += [f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in doubles.split()]
    return f"SELECT {', '.join(columns)} FROM ({sql}) AS result"


def query(name: str, sql: str | None = None, texts: str = "", ints: str = "", doubles: str = ""):
    """Register a query, and with ``sql`` the statement that must give the same rows."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(spark, sf_dir), texts, ints, doubles)

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = tidy_sql(sql, texts, ints, doubles)
        return build

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def entity_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and order year with counts, sums and peer keys.

    Line items are reduced to one row per order, orders to one row per customer and year, before each
    join, so only small rows meet the larger table.
    """
    lines = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"),
        )
    )
    orders = read(spark, sf_dir, "orders")
    yearly = (
        orders.join(lines, on=orders.o_orderkey == lines.l_orderkey, how="left")
        .groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.round(F.round(F.sum("o_totalprice"), 2), 0).alias("value"),
            F.sum("quantity").alias("quantity"),
            F.sum("returned").alias("returned"),
            F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        )
    )
    customers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )
    return yearly.join(customers, on="entity")


E_SQL = """
    SELECT entity, period, orders, value, quantity, returned, finished, urgent,
           c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance
    FROM (
        SELECT o_custkey AS entity, year(o_orderdate) AS period, count(*) AS orders,
               round(round(sum(o_totalprice), 2), 0) AS value, sum(quantity) AS quantity, sum(returned) AS returned,
               count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
               count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
        FROM orders LEFT JOIN (
            SELECT l_orderkey, sum(l_quantity) AS quantity,
                   sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS returned
            FROM lineitem GROUP BY l_orderkey) AS lines ON o_orderkey = l_orderkey
        GROUP BY o_custkey, year(o_orderdate)) AS yearly
    JOIN customer ON c_custkey = entity
"""


def tiered_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer, tier and year with the number and value of orders."""
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderpriority").alias("tier"),
        F.year("o_orderdate").alias("period"),
    ).agg(
        F.count(F.lit(1)).alias("orders"),
        F.round(F.round(F.sum("o_totalprice"), 2), 0).alias("value"),
        F.round(F.max("o_totalprice"), 2).alias("largest"),
    )


TIERED_SQL = """
    SELECT o_custkey AS entity, o_orderpriority AS tier, year(o_orderdate) AS period, count(*) AS orders,
           round(round(sum(o_totalprice), 2), 0) AS value, round(max(o_totalprice), 2) AS largest
    FROM orders GROUP BY o_custkey, o_orderpriority, year(o_orderdate)
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward_label(
        keep(tiered_periods(spark, sf_dir), "tiers"), "entity", "tier", "period", "orders", SOURCES, TARGETS, 3, MIN_ORDERS
    )


LABELLED_SQL = f"""
    SELECT * FROM (
        SELECT s.entity, s.tier, s.period, s.orders, s.value, s.largest,
               CASE WHEN h.target_year IS NOT NULL THEN 1
                    WHEN s.period + 3 <= (SELECT max(year(o_orderdate)) FROM orders) THEN 0 END AS label,
               h.target_tier, h.target_year
        FROM ({TIERED_SQL}) AS s
        LEFT JOIN (
            SELECT entity, period, min(year) AS target_year, arg_min(tier, year) AS target_tier
            FROM (
                SELECT a.entity, a.period, b.period AS year, min(b.tier) AS tier
                FROM (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) AS period FROM orders) AS a
                JOIN ({TIERED_SQL}) AS b
                  ON a.entity = b.entity AND b.period > a.period AND b.period <= a.period + 3
                WHERE b.tier IN ('1-URGENT', '2-HIGH') AND b.orders >= {MIN_ORDERS}
                GROUP BY a.entity, a.period, b.period) AS hits
            GROUP BY entity, period) AS h
          ON s.entity = h.entity AND s.period = h.period
        WHERE s.tier NOT IN ('1-URGENT', '2-HIGH')) AS marked
    WHERE label IS NOT NULL
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with a deterministic score that has ties, and a numeric row id.

    Scores are multiples of 1/997, whose means never end in a rounding tie.
    """
    return labelled(spark, sf_dir).withColumns(
        {
            "score": F.round(F.col("value") / (F.col("value") + F.lit(500000.0)) * 997, 0) / 997,
            "row_id": F.col("entity") * 1000
            + (F.col("period") - 1990) * 10
            + F.substring("tier", 1, 1).cast("long"),
        }
    )


SCORED_SQL = f"""
    SELECT *, round(value / (value + 500000.0::DOUBLE) * 997, 0) / 997 AS score,
           entity * 1000 + (period - 1990) * 10 + CAST(left(tier, 1) AS BIGINT) AS row_id
    FROM ({LABELLED_SQL}) AS labelled
"""
