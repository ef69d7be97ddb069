"""Merkle manifest of a dataset: leaf, subroot, root and proof of every row, and a check of the proofs.

Rows of a source are the leaves of a tree with sixteen children a node; the roots of the sources are the
leaves of one more tree. Every built level is kept as rows that name their parent, and a recursive query
climbs them from the leaves on. Leaves of one run share all siblings above it, so they climb together.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let
from tidemark.shared import keep

FANOUT = 16
#: Runs of leaves that meet in one copy of a node while they climb.
SPREAD = 1024
_TOP = -1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = "spark.sql.cteRecursionRowLimit"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    own = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the values, one after another."""
    return F.sha2(F.concat(*values), 256)


def _hex(value: Column) -> Column:
    """Digests travel as bytes, half the size of the text they are digested as."""
    return F.lower(F.hex(value))


def _joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, _hex), "")


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 0 in an order, null first. Rows are sorted in ranges; a range is one small offset."""
    ordered = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = keep(ordered, "ordered").withColumn("_part", F.shiftrightunsigned("_at", 33))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = keep(parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "offsets")
    number = F.col("_offset") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return placed.join(offsets, "_part").withColumn(name, number).drop("_at", "_part", "_offset")


def _run(k: Column) -> Column:
    return F.floor(k / F.lit(FANOUT)).cast("long")


def _runs_of(n: Column) -> Column:
    return F.floor((n + F.lit(FANOUT - 1)) / F.lit(FANOUT)).cast("long")


def _spread(weight: Column) -> Column:
    return F.ceil(weight / F.lit(SPREAD)).cast("int")


def _levels(bottom: DataFrame, largest: int) -> list[DataFrame]:
    """Written levels above ``bottom`` (tree, level, k, n, hash, weight), n nodes a tree, until each tree has one node.

    Nodes of a level above hold the hashes of their children, in order. A tree that has one node is not built further.
    """
    levels, below, n = [], bottom, largest
    while n > 1:
        child = F.struct("k", "hash", "weight")
        groups = below.where("n > 1").groupBy("tree", "level", "n", _run(F.col("k")).alias("run")).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        hashes = F.transform("kids", lambda x: x["hash"])
        above = groups.select(
            "tree",
            (F.col("level") + 1).alias("level"),
            F.col("run").alias("k"),
            _runs_of(F.col("n")).alias("n"),
            F.unhex(digest(_joined(hashes))).alias("hash"),
            F.aggregate("kids", F.lit(0).cast("long"), lambda a, x: a + x["weight"]).alias("weight"),
            hashes.alias("kids"),
        )
        levels.append(keep(above, "level"))
        below, n = levels[-1], -(-n // FANOUT)
    return levels


def _name(tree: Column, level: Column, k: Column) -> Column:
    return F.concat_ws(":", tree, level, k)


def _linked(nodes: DataFrame, sources: int) -> DataFrame:
    """Nodes (tree, level, k, n, ...) with the name and the place of the next step up; null at the root."""
    inside = F.col("n") > 1
    outside = (F.col("tree") != _TOP) & F.lit(sources > 1)
    tree, k = F.when(inside, F.col("tree")).otherwise(F.lit(_TOP).cast("long")), F.when(inside, F.col("k")).otherwise(F.col("tree"))
    level = F.when(inside, F.col("level") + 1).otherwise(F.lit(1))
    return nodes.withColumns({"up": F.when(inside | outside, _name(tree, level, _run(k))), "place": F.when(inside | outside, F.pmod(k, F.lit(FANOUT)).cast("int"))})


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """Lift the limit on the rows of a recursive query, which is meant for queries that never end."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


_CLIMB = f"""
    WITH RECURSIVE climb(tree, run, folded, path, subroot, node, up, place) AS (
        SELECT tree, run, folded, X'', subroot, node, up, place FROM {{runs}}
        UNION ALL
        SELECT tree, run, transform(folded, f -> unhex(sha2(lower(hex(concat(before, f, after))), 256))), concat(path, before, after),
               coalesce(subroot, own_subroot), hash, next_up, next_place
        FROM (
            SELECT c.tree, c.run, c.folded, c.path, c.subroot, n.own_subroot, n.hash, n.up AS next_up, n.place AS next_place,
                   aggregate(slice(n.kids, 1, c.place), X'', (a, x) -> concat(a, x)) AS before,
                   aggregate(slice(n.kids, c.place + 2, {FANOUT}), X'', (a, x) -> concat(a, x)) AS after
            FROM climb AS c JOIN {{nodes}} AS n
            ON c.up = n.name AND pmod(xxhash64(c.tree, c.run), n.spread) = n.copy)
    )
    SELECT tree, run, folded, path, subroot, node AS root FROM climb WHERE up IS NULL
"""


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    every: int = 5,
) -> DataFrame:
    """One row (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``.

    A leaf digests ``columns``; others are ignored. Leaves of a source ascend by id (null first), equal ids by
    their leaf; sources ascend by their UTF-8 bytes, null first. A row is tampered with, its text put in lower
    case, where ``every`` divides the CRC-32 of its id; a null id or text is left alone. A null source is a
    source like any other, an empty text has the value ``0:``, equal rows are leaves of their own, a lone leaf
    is the root of its source, a lone source the root of all. An empty table gives no rows.

    Only digests leave the rows. The order of a source is found in ranges, so no source is sorted in one task;
    nodes that many leaves climb through are copied, a copy for every ``SPREAD`` runs, so no key of the climb
    is hot. Each level and the result of the climb are written.
    """
    spark = docs.sparkSession
    own = [F.col(c) for c in columns]
    lowered = F.translate(text, _UPPER, _LOWER)
    struck = (F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(every)) == 0) & F.col(text).isNotNull()
    leaf = digest(*[encoded(c) for c in own])
    tampered = digest(*[encoded(lowered if name == text else c) for name, c in zip(columns, own)])
    leaves = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.unhex(leaf).alias("leaf"), F.unhex(F.when(struck, tampered)).alias("tampered"))
    placed = keep(_numbered(leaves, [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.col("leaf")], "at"), "leaves")
    sources = placed.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    sources = keep(_numbered(sources, [F.asc_nulls_first("source")], "tree"), "sources")
    size = sources.agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("sources")).first()
    named = placed.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    k = F.col("at") - F.col("first")
    member = F.struct(k.alias("k"), "doc_id", "leaf", "tampered")
    members = named.groupBy("tree", "n", _run(k).alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    hashes = F.transform("members", lambda x: x["leaf"])

    def folded(own: Column) -> Column:
        alone = F.coalesce(own["tampered"], own["leaf"])
        changed = F.transform("members", lambda x: F.when(x["k"] == own["k"], alone).otherwise(x["leaf"]))
        return F.when(F.col("n") > 1, F.unhex(digest(_joined(changed)))).otherwise(alone)

    def united(every: Column) -> Column:
        """The distinct digests that climb, few where few leaves are changed, and the place of each member's own."""
        return let(F.array_distinct(every), lambda own: F.struct(own.alias("folded"), F.transform(every, lambda x: F.array_position(own, x).cast("int")).alias("slots")))

    runs = members.withColumn("hash", F.when(F.col("n") > 1, F.unhex(digest(_joined(hashes)))).otherwise(hashes[0]))
    runs = keep(runs.withColumn("climbing", let(F.transform("members", folded), united)), "runs")

    bottom = runs.select("tree", F.lit(1).alias("level"), F.col("run").alias("k"), _runs_of(F.col("n")).alias("n"), "hash", F.lit(1).cast("long").alias("weight"))
    inner = _levels(bottom, _ceil(size["largest"] or 0))
    tops = bottom.where("n = 1")
    for level in inner:
        tops = tops.unionByName(level.drop("kids").where("n = 1"))
    roots = tops.select(F.lit(_TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("k"), F.lit(size["sources"]).cast("long").alias("n"), "hash", "weight")
    outer = _levels(keep(roots, "subroots"), size["sources"])
    nodes = bottom.where("false").withColumn("kids", F.array().cast("array<binary>"))
    for level in [*inner, *outer]:
        nodes = nodes.unionByName(level)
    nodes = _linked(nodes, size["sources"]).select(
        _name(F.col("tree"), F.col("level"), F.col("k")).alias("name"),
        "hash", "kids", "up", "place",
        F.when((F.col("tree") != _TOP) & (F.col("n") == 1), F.col("hash")).alias("own_subroot"),
        _spread(F.col("weight")).alias("spread"),
        F.explode(F.sequence(F.lit(0), _spread(F.col("weight")) - 1)).alias("copy"),
    )

    starts = runs.select("tree", "run", F.col("climbing.folded").alias("folded"), F.col("hash").alias("node"), F.col("run").alias("k"), _runs_of(F.col("n")).alias("n"))
    starts = _linked(starts.withColumn("level", F.lit(1)), size["sources"])
    starts = starts.select("tree", "run", "folded", F.when(F.col("n") == 1, F.col("node")).alias("subroot"), "node", "up", "place")
    with _any_number_of_rows(spark):
        climbed = keep(spark.sql(_CLIMB, runs=starts, nodes=keep(nodes, "nodes")), "climbed")

    def others(i: Column) -> Column:
        return _joined(F.transform(F.filter("members", lambda x, j: j != i), lambda x: x["leaf"]))

    both = runs.select("tree", "run", "members", F.col("climbing.slots").alias("slots")).join(climbed, ["tree", "run"])
    row = F.transform(
        "members",
        lambda x, i: F.struct(
            x["doc_id"].alias("doc_id"), _hex(x["leaf"]).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
            digest(others(i), _hex(F.col("path"))).alias("proof_sha256"), _hex(F.get("folded", F.get("slots", i) - 1)).alias("folded_root"),
        ),
    )
    found = both.select(F.inline(row))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _ceil(n: int) -> int:
    return -(-n // FANOUT)
