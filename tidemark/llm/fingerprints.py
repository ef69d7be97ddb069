"""Fingerprints of texts: every shingle hash below a fixed share of the hash range.

The share is the same for all texts, so sketches can be united, intersected and compared however
unequal the texts are, and a sketch of a union is the union of the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import let, shingles, words
from tidemark.shared import keep

SHINGLE = 5
ONE_IN = 4


def sketch(text: Column, size: int = SHINGLE, one_in: int = ONE_IN) -> Column:
    """Sorted distinct shingle hashes in the lowest 1/``one_in`` of the range; a null or empty text has none."""
    limit = -(1 << 63) + (1 << 64) // one_in
    hashes = let(words(text), lambda own: shingles(own, size))
    return F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(limit))))


def shown(found: Column) -> Column:
    """Sketch as text: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Estimated share of common shingles among all; 0 where both sketches are empty."""
    return let(
        F.size(F.array_intersect(left, right)),
        lambda both: F.coalesce(both / F.nullif(F.size(left) + F.size(right) - both, F.lit(0)), F.lit(0.0)),
    )


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the first text's shingles that the second holds; 0 where the first sketch is empty."""
    return F.coalesce(F.size(F.array_intersect(part, whole)) / F.nullif(F.size(part), F.lit(0)), F.lit(0.0))


def neighbours(ids: DataFrame, key: str, carried: str) -> DataFrame:
    """Distinct ids with the id that precedes each in descending order, round the end, and its ``carried`` value.

    Ids are dealt to ranges. Inside a range a window links them; only the two ends of every range meet in
    one task, whose rows are as many as ranges.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(ids.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = W.partitionBy("_part").orderBy(F.desc(key))
    above = F.struct(F.col(key).alias("id"), F.col(carried).alias("value"))
    linked = ranged.withColumn("_above", F.lag(above).over(inside))
    ends = ranged.groupBy("_part").agg(F.min_by(above, key).alias("least"))
    order = W.orderBy(F.desc("_part"))
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select("_part", F.coalesce(F.lag("least").over(order), F.last("least").over(whole)).alias("_outer"))
    joined = linked.join(ends, "_part")
    found = F.coalesce("_above", "_outer")
    return joined.withColumns({"before": found["id"], "before_value": found["value"]}).drop("_part", "_above", "_outer")


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: fingerprint of the text and of its edited form, and two likenesses.

    The edited text has its last third replaced by as many code points of the next document in descending
    order of id; the last document is followed by the first. Null texts are empty. Where an id has several
    rows, the one whose text hashes lowest is the one that precedes and follows. Rows with a null id have
    no next document: their text stays and near_next is 0. Other columns are ignored.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    # A needless alias on one side of the join only would keep Spark from reading the same exchange twice.
    plain = docs.select(F.col(doc_id) if doc_id == "doc_id" else F.col(doc_id).alias("doc_id"), own.alias("text"))
    rows = plain.where("doc_id IS NOT NULL")
    known = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    ids = known.agg(F.max(F.length(own)).alias("n"), F.min(F.xxhash64(own)).alias("hash"))
    links = neighbours(ids, "doc_id", "n")
    # The rows meet their links and what precedes gives them by id alone, so that their texts move once.
    given = rows.join(links, "doc_id").where(F.xxhash64("text").bitwiseXOR(F.col("hash")) == 0)
    given = given.select(
        F.col("before").alias("doc_id"),
        F.substring("text", F.lit(1), F.floor(F.col("before_value") / 3).cast("int")).alias("head"),
        sketch(F.col("text")).alias("next_found"),
    )
    again = F.lag("doc_id").over(W.partitionBy("doc_id").orderBy("doc_id"))
    once = given.withColumn("again", again).where("again IS NULL").drop("again")
    alone = plain.where("doc_id IS NULL").withColumns({"head": F.lit(None).cast("string"), "next_found": F.lit(None).cast("array<bigint>")})
    joined = rows.join(once, "doc_id", "left").unionByName(alone)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    head = F.coalesce(F.substring("head", F.lit(1), cut), F.lit(""))
    edited = F.when(F.col("head").isNull(), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), n - cut), head))
    full = joined.select("doc_id", n.cast("long").alias("n_chars"), sketch(F.col("text")).alias("found"), "next_found", edited.alias("edited"))
    full = full.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_found": sketch(F.col("edited"))})
    empty = F.array().cast("array<bigint>")
    return full.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("found")).alias("fingerprint"),
        shown(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.coalesce("next_found", empty)).alias("near_next"),
    )
