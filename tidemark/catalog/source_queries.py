"""Upserts, unification, fuzzy matching, quality reports and page extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import E_SQL, SCORED_SQL, TIERED_SQL, entity_periods, query, read, scored, tiered_periods
from tidemark.functions import scalar
from tidemark.operators import clean, features, match, quality, unify
from tidemark.shared import keep
from tidemark.sources import pages

_LATEST = "l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"


@query(
    "upsert_latest",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LATEST}) AS rn
                       FROM lineitem) AS r WHERE rn = 1""",
    texts="l_returnflag l_linestatus",
    ints="l_orderkey l_linenumber l_partkey l_suppkey",
    doubles="l_extendedprice",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    order = [F.col("l_shipdate").desc(), *[F.col(c).asc() for c in ties]]
    return unify.latest_per_key(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order)


@query(
    "upsert_replace",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
              CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""",
    texts="o_orderpriority",
    ints="o_orderkey",
    doubles="o_totalprice",
)
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows lack a column of the table and replace whole rows of the same key."""
    stored = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    incoming = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        "o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")
    )
    return unify.upsert(stored, incoming, ["o_orderkey"])


def _three_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ordered, shipped and returned goods per customer and year: three sources that overlap in part."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    sold = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", F.year("l_shipdate").alias("season"))
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.sum("l_extendedprice").alias("amount"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"),
        )
        .join(orders.select("o_orderkey", "o_custkey"), on=F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("id"), "season")
        .agg(
            F.sum("quantity").alias("quantity"),
            F.round(F.sum("amount"), 2).alias("amount"),
            F.sum("returned").alias("returned"),
        )
    )
    lines = keep(sold, "lines")
    customers = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team")
    )
    ordered = orders.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("season")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("amount")
    )
    shipped = lines.select("id", "season", "quantity", "amount")
    returned = lines.where("returned IS NOT NULL").select("id", (F.col("season") + 1).alias("season"), "returned")
    a = keep(ordered.join(customers, on="id"), "ordered")
    b = shipped.join(customers, on="id").withColumns({"name": F.upper("name"), "team": F.initcap("team")})
    c = returned.join(customers, on="id").withColumn("name", F.lower("name"))
    return a, b, c


_THREE_SQL = """
    a AS (SELECT o_custkey AS id, year(o_orderdate) AS season, count(*) AS orders, round(sum(o_totalprice), 2) AS amount,
                 any_value(c_name) AS name, any_value(c_mktsegment) AS team
          FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
    lines AS (SELECT o_custkey AS id, year(l_shipdate) AS season, l_returnflag, l_quantity, l_extendedprice, c_name,
                     c_mktsegment AS team
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey),
    b AS (SELECT id, season, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS amount,
                 any_value(upper(c_name)) AS name, any_value(team[1] || lower(team[2:])) AS team
          FROM lines GROUP BY id, season),
    c AS (SELECT id, season + 1 AS season, sum(l_quantity) AS returned, any_value(lower(c_name)) AS name,
                 any_value(team) AS team
          FROM lines WHERE l_returnflag = 'R' GROUP BY id, season + 1)
"""
_UNIFIED_SQL = f"""
    WITH {_THREE_SQL}
    SELECT coalesce(a.name, b.name, c.name) AS name, coalesce(a.team, b.team, c.team) AS team,
           coalesce(a.season, b.season, c.season) AS season, a.orders, coalesce(b.amount, a.amount) AS amount,
           b.quantity, c.returned, a.id AS a_id, b.id AS b_id, c.id AS c_id
    FROM a FULL OUTER JOIN b ON lower(a.name) = lower(b.name) AND lower(a.team) = lower(b.team) AND a.season = b.season
    FULL OUTER JOIN c ON lower(coalesce(a.name, b.name)) = lower(c.name)
                     AND lower(coalesce(a.team, b.team)) = lower(c.team) AND coalesce(a.season, b.season) = c.season
"""


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _three_sources(spark, sf_dir)
    columns = {
        **{k: [("a", k), ("b", k), ("c", k)] for k in ("name", "team", "season")},
        "orders": [("a", "orders")],
        "amount": [("b", "amount"), ("a", "amount")],
        "quantity": [("b", "quantity")],
        "returned": [("c", "returned")],
        "a_id": [("a", "id")],
        "b_id": [("b", "id")],
        "c_id": [("c", "id")],
    }
    return unify.unify_three(a, b, c, ["name", "team"], ["season"], columns)


@query(
    "unified_full_outer",
    _UNIFIED_SQL,
    texts="name team",
    ints="season orders a_id b_id c_id",
    doubles="amount quantity returned",
)
def unified_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(spark, sf_dir)


@query(
    "quality_report",
    f"""SELECT season, unified_rows, a_id_rows, b_id_rows, c_id_rows, match_rate, missing_orders, missing_returned,
               concat_ws('; ', CASE WHEN a_id_rows = 0 THEN 'no orders' END, CASE WHEN b_id_rows = 0 THEN 'no shipments' END,
                         CASE WHEN match_rate < 0.5 THEN 'low match rate' END,
                         CASE WHEN missing_orders > unified_rows * 0.5 THEN 'more than half: missing_orders' END,
                         CASE WHEN missing_returned > unified_rows * 0.5 THEN 'more than half: missing_returned' END)
                   AS warnings
        FROM (SELECT season, count(*) AS unified_rows, count(a_id) AS a_id_rows, count(b_id) AS b_id_rows,
                     count(c_id) AS c_id_rows,
                     avg(CAST((a_id IS NOT NULL)::INT + (b_id IS NOT NULL)::INT + (c_id IS NOT NULL)::INT >= 2 AS INT))
                         AS match_rate,
                     count(*) FILTER (WHERE orders IS NULL) AS missing_orders,
                     count(*) FILTER (WHERE returned IS NULL) AS missing_returned
              FROM ({_UNIFIED_SQL}) AS u GROUP BY season) AS q""",
    texts="warnings",
    ints="season unified_rows a_id_rows b_id_rows c_id_rows missing_orders missing_returned",
    doubles="match_rate",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(
        unified(spark, sf_dir),
        ["season"],
        ["a_id", "b_id", "c_id"],
        {"missing_orders": "orders", "missing_returned": "returned"},
        {"a_id": "no orders", "b_id": "no shipments"},
    )


@query(
    "source_stats",
    f"""WITH {_THREE_SQL},
        u AS (SELECT team, season FROM a UNION SELECT team, season FROM b UNION SELECT team, season FROM c)
        SELECT (SELECT count(*) FROM a) AS ordered_rows, (SELECT count(*) FROM b) AS shipped_rows,
               (SELECT count(*) FROM c) AS returned_rows, count(DISTINCT team) AS groups,
               count(DISTINCT season) AS periods FROM u""",
    ints="ordered_rows shipped_rows returned_rows groups periods",
)
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _three_sources(spark, sf_dir)
    return quality.source_stats({"ordered": a, "shipped": b, "returned": c}, "team", "season")


@query(
    "distinct_union",
    "SELECT year(o_orderdate) AS season FROM orders UNION SELECT year(l_shipdate) FROM lineitem UNION SELECT year(ts) FROM events",
    ints="season",
)
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [
        read(spark, sf_dir, table).select(F.year(column).alias("season"))
        for table, column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
    ]
    return quality.distinct_union(frames, "season")


@query(
    "overall_counts",
    f"""SELECT count(*) AS n, sum(label) AS positives, count(DISTINCT tier) AS tier_values,
               count(DISTINCT period) AS period_values FROM ({SCORED_SQL}) AS s""",
    ints="n positives tier_values period_values",
)
def overall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overall_counts(scored(spark, sf_dir), "label", ["tier", "period"])


@query(
    "cleaning_report",
    f"""SELECT count(*) AS total_raw, count(*) FILTER (WHERE segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))
                   AS after_position_norm,
               count(*) FILTER (WHERE segment = 'HOUSEHOLD') AS gk_removed,
               count(*) FILTER (WHERE segment IN ('BUILDING', 'MACHINERY') AND orders BETWEEN 17 - 15 AND 26)
                   AS after_age_filter,
               count(*) FILTER (WHERE segment IN ('BUILDING', 'MACHINERY') AND orders BETWEEN 17 - 15 AND 26
                                AND value / 1000 >= 450) AS after_minutes_filter
        FROM ({E_SQL}) AS e""",
    ints="total_raw after_position_norm gk_removed after_age_filter after_minutes_filter",
)
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {"BUILDING": "FW", "MACHINERY": "MF", "HOUSEHOLD": "GK"}
    rows = entity_periods(spark, sf_dir).select(
        scalar.mapping(codes, F.col("segment")).alias("position"),
        F.col("orders").alias("age"),
        (F.col("value") / 1000).alias("minutes"),
    )
    return clean.cleaning_report(rows, min_age=2)


@query(
    "feature_report",
    f"SELECT count(*) AS input_rows, count(*) FILTER (WHERE orders >= 2) AS output_rows, 2 AS features_created FROM ({E_SQL}) AS e",
    ints="input_rows output_rows features_created",
)
def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = entity_periods(spark, sf_dir)
    return features.feature_report(before, features.add_rates(before, ["value", "quantity"], "orders", "_rate", 2))


@query(
    "merge_overwrite",
    """SELECT c_custkey, c_nationkey, CASE WHEN e.user_id IS NOT NULL THEN e.balance
                                            WHEN o.o_custkey IS NOT NULL THEN o.balance ELSE c_acctbal END AS balance,
              o.n_orders, e.n_events
       FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(max(o_totalprice), 2) AS balance
                  FROM orders GROUP BY o_custkey) AS o ON c_custkey = o.o_custkey
       LEFT JOIN (SELECT user_id, count(*) AS n_events, max(CASE WHEN event_type = 'error' THEN value END) AS balance
                  FROM events GROUP BY user_id) AS e ON c_custkey = e.user_id""",
    ints="c_custkey c_nationkey n_orders n_events",
    doubles="balance",
)
def merge_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later tables overwrite the shared balance, also with NULL."""
    base = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("balance"))
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.max("o_totalprice"), 2).alias("balance")
    )
    events = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("balance"),
    )
    return unify.merge_overwrite(base, [orders, events], "c_custkey")


@query(
    "union_shared",
    f"""SELECT entity, tier, period, label, fold FROM (SELECT entity, tier, period, label, 1 AS fold FROM ({SCORED_SQL}) AS s
        UNION ALL SELECT entity, tier, period, NULL, 0 FROM ({TIERED_SQL}) AS t WHERE period = 2001) AS u""",
    texts="tier",
    ints="entity period label fold",
)
def union_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = scored(spark, sf_dir).select("entity", "tier", "period", "label", F.lit(1).alias("fold"), "score")
    current = tiered_periods(spark, sf_dir).where("period = 2001")
    return unify.union_shared(history, current, {"label": F.lit(None).cast("int"), "fold": F.lit(0)})


@query(
    "first_per_key",
    """SELECT user_id, event_id, event_type FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) AS r WHERE rn = 1""",
    texts="event_type",
    ints="user_id event_id",
)
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    return pages.first_listed(read(spark, sf_dir, "events"), ["user_id"], order)


def _misspelt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All parts with one letter of the name missing, and all parts as they are."""
    parts = read(spark, sf_dir, "part")
    cut = "concat(substr(p_name, 1, p_partkey % length(p_name)), substr(p_name, p_partkey % length(p_name) + 2))"
    shared = [F.col("p_partkey"), F.col("p_brand"), F.col("p_type").alias("team"), F.col("p_size")]
    left = parts.select(*shared, F.expr(cut).alias("name"))
    return left, parts.select(*shared, F.col("p_name").alias("name"))


# Longest common subsequence by rows of its table: the new row is the running maximum of the old one
# and of the old one shifted by a matching letter.
_MATCH_SQL = """
    WITH RECURSIVE
    l AS (SELECT p_partkey, p_brand, p_type AS team, trim(lower(
              p_name[1:p_partkey % length(p_name)] || p_name[p_partkey % length(p_name) + 2:])) AS name FROM part),
    r AS (SELECT p_brand, p_type AS team, lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY ALL),
    texts AS (SELECT DISTINCT l.name AS a, r.name AS b FROM l JOIN r USING (p_brand)
              UNION SELECT DISTINCT l.team, r.team FROM l JOIN r USING (p_brand)),
    dp AS (
        SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS best FROM texts
        UNION ALL
        SELECT a, b, i + 1, list_concat([0], list_transform(range(1, length(b) + 1), lambda j:
            list_max(list_transform(range(1, j + 1), lambda k:
                greatest(best[k + 1], best[k] + CASE WHEN a[i + 1] = b[k] THEN 1 ELSE 0 END)))))
        FROM dp WHERE i < length(a)),
    alike AS (SELECT a, b, 200.0::DOUBLE * best[length(b) + 1] / (length(a) + length(b)) AS s FROM dp WHERE i = length(a)),
    scores AS (
        SELECT l.p_partkey, r.id, n.s * 0.8::DOUBLE + t.s * 0.2::DOUBLE AS score
        FROM l JOIN r USING (p_brand) JOIN alike AS n ON n.a = l.name AND n.b = r.name
        JOIN alike AS t ON t.a = lower(l.team) AND t.b = lower(r.team)),
    best AS (SELECT p_partkey, id, score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, id) AS rn
             FROM scores WHERE score >= 80)
    SELECT part.p_partkey, best.id AS match_id, best.score AS match_confidence, m.p_size AS matched_size
    FROM part LEFT JOIN best ON part.p_partkey = best.p_partkey AND rn = 1 LEFT JOIN part AS m ON m.p_partkey = best.id
""".replace("p_type AS team, trim", "lower(p_type) AS team, trim").replace("p_type AS team, lower", "lower(p_type) AS team, lower")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _misspelt(spark, sf_dir)
    return match.best_match(left, right, ["p_brand"], "p_partkey")


@query(
    "fuzzy_best_match",
    f"SELECT p_partkey, match_id, match_confidence FROM ({_MATCH_SQL}) AS m",
    ints="p_partkey match_id",
    doubles="match_confidence",
)
def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)


@query(
    "match_enrich",
    f"SELECT p_partkey, matched_size, match_confidence FROM ({_MATCH_SQL}) AS m",
    ints="p_partkey matched_size",
    doubles="match_confidence",
)
def match_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _misspelt(spark, sf_dir)
    found = match.best_match(left, right, ["p_brand"], "p_partkey")
    return match.enrich(found, right, ["p_brand"], "p_partkey", set_columns={"matched_size": "p_size"})


@query(
    "match_report",
    f"""SELECT count(*) AS records, count(match_confidence) AS match_confidence_matched,
               avg(match_confidence) AS match_confidence_mean FROM ({_MATCH_SQL}) AS m""",
    ints="records match_confidence_matched",
    doubles="match_confidence_mean",
)
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_report(_matched(spark, sf_dir), ["match_confidence"])


@query(
    "normalize_names",
    """SELECT doc_id, regexp_replace(trim(lower(strip_accents(replace(replace(replace(replace(replace(replace(replace(
           replace(replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), 'Œ', 'OE'), 'ø', 'o'), 'Ø', 'O'),
           '–', '-'), '—', '--'), '“', ''), '’', ''))), E' \\t\\r\\n'), '[^a-z0-9 -]', '', 'g') AS name FROM documents""",
    texts="name",
    ints="doc_id",
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.text import normalize_name

    return read(spark, sf_dir, "documents").select("doc_id", normalize_name(F.col("text")).alias("name"))


@query(
    "extract_links",
    """SELECT page_id, unnest(range(0, len(found))) AS link_no, unnest(found) AS href,
       FROM (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1) AS found FROM pages) AS p""",
    texts="href",
    ints="page_id link_no",
)
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(read(spark, sf_dir, "pages"))


@query(
    "url_parts",
    """SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS host,
              nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') AS number FROM pages""",
    texts="host number",
    ints="page_id",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(
        "page_id",
        scalar.extract(F.col("url"), "^https?://([^/]+)/").alias("host"),
        scalar.extract(F.col("url"), "/([0-9]+)(?:[?#]|$)").alias("number"),
    )


def _cell(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'<td data-stat="{name}">'), F.coalesce(value.cast("string"), F.lit("-")), F.lit("</td>"))


def stat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per customer and year: a stat table, a repeated header, and a table inside a comment.

    The first table has no body of its own, a cell holds a table, quotes and letter case vary, and end tags are left out.
    """
    hex_id = F.lower(F.hex(F.col("entity") + 1048576))
    link = F.concat(F.lit('<th data-stat="player"><a href="/en/players/'), hex_id, F.lit('/x">'), F.col("name"), F.lit("</a></th>"))
    grouped = F.regexp_replace(F.col("value").cast("long").cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")
    standard = [
        link, _cell("nationality", F.concat(F.lit("<a>"), F.col("nation").cast("string"), F.lit("</a>"))),
        _cell("position", F.col("segment")), _cell("team", F.lit("A &amp; B")), _cell("age", F.col("orders")),
        _cell("games", F.col("orders")), _cell("minutes", grouped), _cell("goals", F.col("urgent")),
        _cell("assists", F.lit("31.7")), F.lit("<td data-stat='note'><table><tbody><tr><td data-stat=xg>9</td></tr></tbody></table></td>"),
        _cell("xg", F.col("quantity")), _cell("progressive_carries", F.lit(7)),
    ]
    shooting = [link, _cell("shots", F.col("finished")), _cell("shots_per90", F.col("returned"))]
    possession = [link, _cell("touches", F.col("orders")), _cell("progressive_carries", F.col("urgent"))]

    def table(name: str, row: list[Column]) -> Column:
        return F.concat(F.lit(f'<table id="{name}"><tbody><tr class="thead"><th>h</th></tr><tr>'), *row, F.lit("</tr></tbody></table>"))

    html = F.concat(
        F.lit("<html><body><table id='summary'><thead><tr><th>no body</th></tr></thead></table>"),
        table("stats_standard", standard),
        F.lit('<!-- <div class="table_container" id="d">\n'),
        table("stats_shooting", shooting),
        F.lit("</div> -->"),
        F.replace(F.replace(table("stats_possession", possession), F.lit("</td>"), F.lit("")), F.lit("<tr>"), F.lit("<TR class=wide>")),
        F.lit("</body></html>"),
    )
    stand_ins = entity_periods(spark, sf_dir).select((F.col("entity") * 10000 + F.col("period")).alias("page_id"), html.alias("html"))
    return keep(stand_ins.repartition(spark.sparkContext.defaultParallelism, "page_id"), "pages")


@query(
    "extract_cells",
    f"""SELECT entity * 10000 + period AS page_id, lower(to_hex(entity + 1048576)) AS player_id, name,
               CAST(nation AS VARCHAR) AS nationality, segment AS position, 'A & B' AS team, orders AS games,
               value AS minutes, urgent AS goals, NULL AS assists, quantity AS xg, finished AS shots,
               returned AS shots_per90, orders AS touches, urgent AS progressive_carries FROM ({E_SQL}) AS e""",
    texts="player_id name nationality position team",
    ints="page_id games minutes goals assists shots touches progressive_carries",
    doubles="xg shots_per90",
)
def extract_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stat tables of each page, two of them absent, merged by player."""
    return pages.counts_records(stat_pages(spark, sf_dir), ["page_id"])


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per part: the listing lies in a layout table, and each name and position in a table of its cell."""
    price = F.format_string("€%.2fk", "p_retailprice")
    html = F.concat(
        F.lit("<TABLE><tr><td><table class='wide items'><tbody><tr class=\"head\"><td>x</td></tr><tr class=odd>"),
        F.lit("<td class='posrela'><table class='inline-table'><tr><td class='hauptlink'><a title='t' href=\"/"),
        F.replace("p_name", F.lit(" "), F.lit("-")),
        F.lit("/profil/spieler/"),
        F.col("p_partkey").cast("string"),
        F.lit('">\n'),
        F.col("p_name"),
        F.lit('</a></td></tr><tr><td>Left Winger</td></tr></table></td><td class="zentriert">'),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("?"),
        F.lit("</td><td><a class=vereinprofil_tooltip title=\""),
        F.col("p_brand"),
        F.lit('">b</a></td><td><img class="flaggenrahmen" title="'),
        F.col("p_type"),
        F.lit('"></td><td class="rechts hauptlink">'),
        price,
        F.lit("</td></tr></tbody></table></td></tr></TABLE>"),
    )
    parts = read(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism, "p_partkey", "p_name")
    return parts.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@query(
    "extract_listing",
    """SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS player_id, replace(p_name, ' ', '-') AS player_slug,
              p_name AS name, 'Left Winger' AS position, CASE WHEN p_size > 25 THEN p_size END AS age,
              p_type AS nationality, p_brand AS team,
              CAST(trunc(CAST(printf('%.2f', p_retailprice) AS DOUBLE) * 1000.0::DOUBLE) AS BIGINT) AS market_value_eur
       FROM part""",
    texts="player_id player_slug name position nationality team",
    ints="page_id age market_value_eur",
)
def extract_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.listing_records(listing_pages(spark, sf_dir))


@query(
    "extract_profile",
    """SELECT c_custkey AS page_id, CAST('2000-01-31' AS DATE) + CAST(c_custkey % 3000 AS INT) AS born,
              100 + c_nationkey AS height_cm, 'left' AS foot, c_mktsegment AS nationality, NULL AS contract,
              CAST(trunc(CAST(printf('%.2f', abs(c_acctbal)) AS DOUBLE) * 1000000.0::DOUBLE) AS BIGINT) AS worth FROM customer""",
    texts="born foot nationality contract",
    ints="page_id height_cm worth",
)
def extract_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = '<span class="info-table__content info-table__content--label">{}:</span><span class="info-table__content">'
    born = F.date_add(F.lit("2000-01-31").cast("date"), (F.col("c_custkey") % 3000).cast("int"))
    html = F.concat(
        F.lit('<div class="info-table">' + label.format("Date of birth")),
        F.date_format(born, "MMM d, yyyy"),
        F.lit("</span>" + label.format("Height")),
        F.format_string("1,%02d m", "c_nationkey"),
        F.lit("</span>" + label.format("Foot") + "Left</span>" + label.format("Citizenship")),
        F.col("c_mktsegment"),
        F.lit("</span>" + label.format("Contract expires") + '-</span></div><div class="tm-player-market-value-development__current-value">'),
        F.format_string("€%.2fm", F.abs("c_acctbal")),
        F.lit("</div>"),
    )
    rows = pages.profile_records(
        read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html"))
    )
    return rows.withColumns(
        {
            "born": F.col("date_of_birth").cast("string"),
            "contract": F.col("contract_expires").cast("string"),
            "worth": F.col("market_value_eur"),
        }
    )


@query(
    "json_records",
    f"""SELECT CAST(entity AS VARCHAR) AS player_id, name, CASE segment WHEN 'BUILDING' THEN 'FW' ELSE segment END AS position,
               orders AS games, orders * 97 AS minutes, coalesce(urgent, 0) AS goals, finished AS npg,
               coalesce(quantity, 0) AS xg, returned AS xg_chain,
               round(coalesce(quantity, 0) / (orders * 97 / 90.0::DOUBLE), 2) AS xg_per90,
               round(urgent - coalesce(quantity, 0), 2) AS xg_overperformance, period FROM ({E_SQL}) AS e""",
    texts="player_id name position",
    ints="period games minutes goals npg",
    doubles="xg xg_chain xg_per90 xg_overperformance",
)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with an array of one record, all values text, per customer and year."""
    fields = {
        "id": "entity", "player_name": "name", "games": "orders", "time": "orders * 97", "goals": "urgent",
        "xG": "quantity", "position": "CASE segment WHEN 'BUILDING' THEN 'F S' ELSE segment END", "npg": "finished",
        "xGChain": "returned",
    }
    record = F.to_json(F.array(F.struct(*[F.expr(f"CAST({e} AS STRING)").alias(k) for k, e in fields.items()])))
    html = F.concat(F.lit("<script>var playersData = JSON.parse('"), record, F.lit("');</script>"))
    source = entity_periods(spark, sf_dir).select("period", html.alias("html"))
    return pages.json_records(source, pages.embedded_json(F.col("html")))


@query(
    "event_properties",
    "SELECT event_id, coalesce(TRY_CAST(props->>'$.k' AS INT), -1) AS k FROM events",
    ints="event_id k",
)
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.from_json("props", "k string")["k"]
    return read(spark, sf_dir, "events").select("event_id", scalar.safe_cast(text, "int", -1).alias("k"))


@query(
    "parse_numbers",
    """SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, o_totalprice AS amount, NULL AS rejected, NULL AS dash
       FROM orders""",
    ints="o_orderkey whole rejected dash",
    doubles="amount",
)
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" "))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalar.parse_number(F.format_number(F.col("o_totalprice"), 0), True).alias("whole"),
        scalar.parse_number(spaced).alias("amount"),
        scalar.parse_number(F.concat(spaced, F.lit("x")), True).alias("rejected"),
        scalar.parse_number(F.lit("-")).alias("dash"),
    )


@query(
    "parse_money",
    """SELECT o_orderkey, CAST(trunc(CAST(printf('%.2f', o_totalprice) AS DOUBLE)
                  * CASE o_orderstatus WHEN 'F' THEN 1000000.0::DOUBLE WHEN 'O' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT)
              AS euros FROM orders""",
    ints="o_orderkey euros",
)
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("o_orderstatus") == "F", "M").when(F.col("o_orderstatus") == "O", "k").otherwise("")
    text = F.concat(F.lit("€"), F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")), unit)
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.parse_money(text).alias("euros"))


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL
                               ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
    texts="day",
    ints="o_orderkey",
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = {"1-URGENT": "MMM d, yyyy", "2-HIGH": "dd.MM.yyyy", "3-MEDIUM": "yyyy-MM-dd", "4-NOT SPECIFIED": "dd/MM/yyyy"}
    text = F.lit("soon")
    for priority, layout in layouts.items():
        text = F.when(F.col("o_orderpriority") == priority, F.date_format("o_orderdate", layout)).otherwise(text)
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.parse_date(text).cast("string").alias("day"))
