"""Rankings, percentiles, profiles, searches and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import E_SQL, entity_periods, query, read
from tidemark.functions import scalar
from tidemark.operators import explore

DIMENSIONS = 64
MEASURES = ["value", "quantity", "returned"]


def keyed_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_periods(spark, sf_dir).withColumn("row_id", F.col("entity") * 10000 + F.col("period"))


_KEYED = f"SELECT *, entity * 10000 + period AS row_id FROM ({E_SQL}) AS e"


@query(
    "ranked_list",
    f"SELECT row_id, value, row_number() OVER (ORDER BY value DESC, row_id) AS rank FROM ({_KEYED}) AS k",
    ints="row_id rank",
    doubles="value",
)
def ranked_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.ranked(keyed_periods(spark, sf_dir), "value", "row_id")


@query(
    "top_bottom_n",
    f"""(SELECT 'top' AS side, row_id, value FROM ({_KEYED}) AS k WHERE segment = 'MACHINERY'
         ORDER BY value DESC, row_id LIMIT 20)
        UNION ALL
        (SELECT 'bottom', row_id, value FROM ({_KEYED}) AS k WHERE segment = 'MACHINERY' ORDER BY value, row_id LIMIT 20)""",
    texts="side",
    ints="row_id",
    doubles="value",
)
def top_bottom_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_periods(spark, sf_dir).where("segment = 'MACHINERY'")
    top = explore.top_rows(rows, 20, [F.col("value").desc(), F.col("row_id").asc()])
    bottom = explore.top_rows(rows, 20, [F.col("value").asc(), F.col("row_id").asc()])
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


@query(
    "top_per_group",
    f"""SELECT nation, rank, row_id FROM (
            SELECT *, row_number() OVER (PARTITION BY nation ORDER BY value DESC, row_id) AS rank FROM ({_KEYED}) AS k) AS r
        WHERE rank <= 3""",
    ints="nation rank row_id",
)
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("value").desc(), F.col("row_id").asc()]
    return explore.top_per_group(keyed_periods(spark, sf_dir), ["nation"], order, 3)


@query(
    "search_filter",
    f"""SELECT row_id, name FROM ({_KEYED}) AS k
        WHERE (returned BETWEEN 10 AND 60 OR returned IS NULL) AND value >= 100000 AND segment = 'BUILDING'
          AND regexp_matches(name, '(?i)CUSTOMER#0+[1-9]*7')""",
    texts="name",
    ints="row_id",
)
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = [
        scalar.in_range_or_null(F.col("returned"), 10, 60),
        F.col("value") >= 100000,
        F.col("segment") == "BUILDING",
        scalar.name_matches(F.col("name"), "CUSTOMER#0+[1-9]*7"),
    ]
    return keyed_periods(spark, sf_dir).where(scalar.all_of(conditions))


_PERCENTILES = " UNION ALL ".join(
    f"""SELECT row_id, segment, '{c}' AS feature, CASE WHEN {c} IS NULL THEN 50 ELSE
        100 * cume_dist() OVER (PARTITION BY segment, {c} IS NULL ORDER BY {c}) END AS percentile FROM ({_KEYED}) AS k"""
    for c in MEASURES
)


@query("peer_percentile", _PERCENTILES, texts="segment feature", ints="row_id", doubles="percentile")
def peer_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.peer_percentiles(keyed_periods(spark, sf_dir), "row_id", "segment", MEASURES)


@query(
    "radar_profile",
    f"""SELECT row_id, segment, feature, percentile, 50 AS group_average FROM ({_PERCENTILES}) AS p
        WHERE (segment = 'BUILDING' AND feature IN ('value', 'returned'))
           OR (segment = 'MACHINERY' AND feature IN ('quantity'))""",
    texts="segment feature",
    ints="row_id",
    doubles="percentile group_average",
)
def radar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    percentiles = explore.peer_percentiles(keyed_periods(spark, sf_dir), "row_id", "segment", MEASURES)
    listed = {"BUILDING": ["value", "returned"], "MACHINERY": ["quantity"]}
    return explore.radar_profile(percentiles, "row_id", "segment", listed)


@query(
    "nearest_neighbours",
    """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
       s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM u GROUP BY i),
       z AS (SELECT vec_id, i, (v - m) / CASE WHEN d = 0 THEN 1 ELSE d END AS z FROM u JOIN s USING (i)),
       q AS (SELECT min(vec_id) AS query_id FROM embeddings GROUP BY label),
       d AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS distance
             FROM z AS a JOIN z AS b USING (i) WHERE a.vec_id IN (SELECT query_id FROM q) AND a.vec_id <> b.vec_id
             GROUP BY a.vec_id, b.vec_id)
       SELECT query_id, vec_id, distance, rank FROM (
           SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) AS r WHERE rank <= 5""",
    ints="query_id vec_id rank",
    doubles="distance",
)
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows most like the first member of each label."""
    rows = read(spark, sf_dir, "embeddings")
    spread = rows.select("vec_id", "label", *[F.col("embedding")[i].alias(f"e{i}") for i in range(DIMENSIONS)])
    ready = explore.standardized(spread, [f"e{i}" for i in range(DIMENSIONS)]).select("vec_id", "label", "features")
    first = ready.groupBy("label").agg(F.min_by(F.struct("vec_id", "features"), "vec_id").alias("q")).select("q.*")
    return explore.nearest_neighbours(ready, first, "vec_id", 5)


@query(
    "display_percent",
    f"SELECT row_id, round(CAST(finished AS DOUBLE) / orders * 100, 1) AS finished_pct FROM ({_KEYED}) AS k",
    ints="row_id",
    doubles="finished_pct",
)
def display_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = scalar.percent(F.col("finished") / F.col("orders"))
    return keyed_periods(spark, sf_dir).withColumn("finished_pct", share)
