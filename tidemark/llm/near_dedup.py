"""Near duplicates: fast similarity sketches, banding, and exact comparison of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidemark.llm.common import let, runs, words
from tidemark.shared import keep

BINS = 128
#: Values per band. A pair of similarity 0.8 misses all 32 bands with a chance of 5 in 100 million.
BAND = 4
#: Ratio of the sizes that bound a class of sizes.
_CLASS = 1.02
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer of well-spread bits, one function per seed."""
    x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(elements: np.ndarray, owner: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """One sketch of ``bins`` values per row, from the elements (64-bit hashes) and the row each belongs to.

    Round i throws every element into one bin; a bin keeps the least value of the first round that
    reaches it. From round ``bins`` on, all elements go to bin i - ``bins``, so every coordinate of a row
    with an element fills. Rows leave as soon as they are full, after a few rounds if they are long.
    """
    result = np.full(rows * bins, np.iinfo(np.uint64).max, np.uint64)
    elements = elements.astype(np.uint64, copy=False)
    for i in range(2 * bins):
        if not len(elements):
            break
        hashed = _mixed(elements, i)
        bin_ = (hashed % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(elements), i - bins)
        # The round stands in the highest byte, so a value of an earlier round is always less.
        value = (hashed >> np.uint64(8)) | (np.uint64(i) << np.uint64(56))
        slot = owner * bins + bin_
        empty = result[slot] == np.iinfo(np.uint64).max
        slot, value = slot[empty], value[empty]
        order = np.argsort(value)[::-1]
        result[slot[order]] = value[order]
        full = (result.reshape(rows, bins) != np.iinfo(np.uint64).max).all(axis=1)
        if i == 0 or full[owner].any():
            left = ~full[owner]
            elements, owner = elements[left], owner[left]
    return result.reshape(rows, bins)


def band_keys(sketch: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key per band; keys of different bands differ."""
    rows, bins = sketch.shape
    keys = np.zeros((rows, bins // band), np.uint64)
    for k in range(bins // band):
        for j in range(band):
            keys[:, k] = _mixed(keys[:, k] ^ sketch[:, k * band + j], 1000 + k)
    return keys


@arrow_udf(T.ArrayType(T.LongType()))
def _banded(sets: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in sets:
        found = []
        for low in range(0, len(batch), 256):
            part = batch.slice(low, 256)
            sizes = np.diff(part.offsets.to_numpy())
            elements = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            found.append(band_keys(sketches(elements, np.repeat(np.arange(len(part)), sizes), len(part))).view(np.int64))
        keys = np.concatenate(found) if found else np.zeros((0, BINS // BAND), np.int64)
        yield pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * (BINS // BAND), pa.array(keys.ravel()))


def _lowered(word: Column) -> Column:
    """A-Z in lower case. A word of ASCII alone, as most are, takes the cheaper function."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def shingle_set(text: Column, size: int) -> Column:
    """Sorted distinct hashes of the runs of ``size`` words, A-Z in lower case; fewer words are one run."""

    def shingles(own: Column) -> Column:
        short = F.when(F.size(own) > 0, F.array(F.xxhash64(own))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(own) >= size, runs(own, size)).otherwise(short)

    return F.sort_array(F.array_distinct(let(F.transform(words(text), lambda w: F.xxhash64(_lowered(w))), shingles)))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b): the least node it is connected with.

    Large-star and small-star steps in turn: neighbours are tied to the least node around until nothing
    changes. Each step is written, so a lost executor costs one step, and no step gathers a component.
    """
    current = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    state = None
    while True:
        both = current.select(F.col("u").alias("n"), F.col("v").alias("m")).union(current.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("root"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("v"), F.col("root").alias("u")).distinct()
        large = keep(large.where("v <> u"), "edges")
        down = large.groupBy("v").agg(F.min("u").alias("root"))
        tied = large.join(down, "v")
        small = tied.select(F.col("u").alias("v"), F.col("root").alias("u")).union(tied.select("v", F.col("root").alias("u")))
        current = keep(small.where("v <> u").distinct(), "edges")
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return keep(current.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots), "components")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets share ``percent`` of their union."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    joined = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    judged = joined.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return judged.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("a", "b")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n + 0.5) / F.log(F.lit(_CLASS))).cast("int")


def _crossing(strays: DataFrame, others: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of a stray and another row in different components that can share ``percent`` of their union.

    Partners share only shingles that several components hold, the reachable ones. In the order of all
    reachable shingles from the rarest on, the first one that two partners share stands so early in both
    that they need to be paired only through the first few of each.
    """
    parts = others.select("rep", "part").distinct()
    held = sets.join(parts, "rep").select("rep", "part", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    spread = held.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("df"))
    ranked = held.join(spread.where("low < high").select("shingle", "df"), "shingle").groupBy("rep", "part", "n")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    n, reach = F.col("n"), F.size("rare")
    least = F.ceil(n * percent / 100).cast("int")
    most = F.floor(F.least(n * 100 / percent, reach * (100 + percent) / percent - n)).cast("int")
    able = keep(ranked.withColumns({"least": least, "most": most}).where("least <= most"), "able")

    def first(smallest: Column) -> Column:
        """The rarest reachable shingles, one of which a partner of at least this size holds, and their places."""
        needed = F.ceil((n + smallest) * percent / (100 + percent)).cast("int")
        few = F.slice("rare", F.lit(1), F.greatest(reach - needed + 1, F.lit(0)))
        return F.inline(F.transform(few, lambda x, i: F.struct(x["shingle"].alias("shingle"), (reach - i).alias("rest"))))

    def side(rows: DataFrame, sized: Column, smallest: Column, end: str) -> DataFrame:
        own = [F.col(c).alias(f"{c}_{end}") for c in ("rep", "part", "n", "least", "most")]
        return rows.select(sized.alias("sized"), *own, first(smallest)).withColumnRenamed("rest", f"rest_{end}")

    asked = able.join(strays.select("rep").distinct(), "rep", "left_semi")
    asked = asked.withColumn("sized", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))))
    smallest = F.greatest(F.col("least"), F.floor(F.pow(F.lit(_CLASS), F.col("sized")) - 0.5).cast("int"))
    left, right = side(asked, F.col("sized"), smallest, "a"), side(able, _size_class(n), F.col("least"), "b")
    alike = (F.col("part_a") != F.col("part_b")) & F.col("n_b").between(F.col("least_a"), F.col("most_a")) & F.col("n_a").between(F.col("least_b"), F.col("most_b"))
    # Where two partners share their first shingle, enough of both must still follow.
    enough = (100 + percent) * F.least("rest_a", "rest_b").cast("long") >= percent * (F.col("n_a") + F.col("n_b")).cast("long")
    met = left.join(right, ["shingle", "sized"]).where(alike & enough)
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of ``docs``; other columns are ignored.

    Texts with equal sets form a class, which takes part once, named by its least id and the hash of its set. Classes that share a
    band meet first the least class of the band; the one a class meets most often is compared with it.
    Then classes outside the main component of a band are compared with all classes of the band in other
    components that could be alike, so no link between components is lost. Nearly all pairs are ruled out
    before they are made, see ``_crossing``. All comparisons are of full sets.

    Null and empty texts are linked with nothing. A row with a null id is linked with nothing and kept.
    Rows that repeat an id are judged one by one.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), shingle_set(F.col(text), size).alias("set"))
    known = F.col("doc_id").isNotNull() & (F.size("set") > 0)
    keyed = own.select(
        "doc_id",
        F.size("set").cast("long").alias("n_shingles"),
        F.when(known, F.xxhash64("set")).alias("k1"),
        F.when(known, F.xxhash64(F.lit(1), F.col("set"))).alias("k2"),
        _banded("set").alias("bands"),
    )
    marked = keep(keyed, "sketches")
    united = marked.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # An id may be the least of several classes, so the hash is part of the name.
    classes = keep(united.select("k1", "k2", F.struct("id", "k1").alias("rep"), "n", "bands"), "classes")
    members = classes.select(F.explode("bands").alias("band"), "rep", "n")
    heads = members.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).where("head < tail").select("band", "head")
    met = keep(members.join(heads, "band"), "members")
    spokes = met.where("rep <> head").groupBy("rep", "head").count()
    first = spokes.groupBy("rep").agg(F.min_by("head", F.struct(-F.col("count"), F.col("head"))).alias("head"))
    first = keep(first.select(F.col("head").alias("a"), F.col("rep").alias("b")), "pairs")
    wanted = classes.select("rep", "k1", "k2").join(met.select("rep").distinct(), "rep")
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(wanted, F.col("_id") == F.col("rep.id"))
    # Inside a generator: as a condition on columns it would become keys of the join, and the sets be made for each of them.
    own = lambda found: (F.xxhash64(found) == F.col("k1")) & (F.xxhash64(F.lit(1), found) == F.col("k2"))
    sets = texts.select("rep", F.explode(F.filter(F.array(shingle_set(F.col("_text"), size)), own)).alias("set"))
    sets = keep(sets.dropDuplicates(["rep"]), "sets")
    linked = keep(_confirmed(first, sets, percent), "links")
    tied = components(linked)
    placed = met.join(tied.withColumnRenamed("node", "rep"), "rep", "left")
    placed = keep(placed.select("band", "rep", "n", F.coalesce("component", "rep").alias("part")), "placed")
    sizes = placed.groupBy("band", "part").count()
    main = sizes.groupBy("band").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    split = main.where("parts > 1").select("band", "main")
    strays = placed.join(split, "band").where("part <> main")
    others = placed.join(split.select("band"), "band", "left_semi")
    crossed = _crossing(strays, others, sets, percent)
    crossed = crossed.join(first, ["a", "b"], "left_anti")
    linked = linked.union(keep(_confirmed(keep(crossed, "pairs"), sets, percent), "links"))
    tied = components(linked).withColumnRenamed("node", "rep")
    places = classes.select("k1", "k2", "rep").join(tied, "rep", "left").select("k1", "k2", F.coalesce("component", "rep")["id"].alias("part"))
    result = marked.select("doc_id", "n_shingles", "k1", "k2").join(places, ["k1", "k2"], "left")
    component = F.coalesce("part", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, with their own columns, that have the least id of their component; null ids stay."""
    kept = link(docs, doc_id, text, size, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[doc_id].eqNullSafe(kept["_kept"]), "left_semi")
