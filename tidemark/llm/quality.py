"""Quality of a text: counts any reader can check, and how much its n-grams look like trusted text."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, runs, sampled_rows, words
from tidemark.shared import keep

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Ratios are whole numbers of this part while they are summed.
_UNIT = 1_000_000
#: The threshold is a whole number of this part, so that the values it is chosen from are few.
_STEP = 10_000


#: Buckets of a text that are looked up and summed as one row.
_CHUNK = 8


@dataclass(frozen=True)
class QualityModel:
    """Log-likelihood ratio of trusted text against the corpus for every n-gram bucket, and the least mean that passes."""

    ratios: Sequence[float]
    threshold: float
    steady: int


def _repeated(own: Column) -> Column:
    """Words that lie in a window of five found twice or more."""

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def again(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def counted(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ordered, again)).otherwise(F.lit(0))

    windows = let(F.transform(own, lambda w: F.xxhash64(w)), lambda hashes: runs(hashes, WINDOW))
    return F.when(F.size(own) > WINDOW, let(windows, counted)).otherwise(F.lit(0))


def base_counts(text: Column) -> Column:
    """Struct of the plain counts; a null text counts as an empty one."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    repeats = let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))

    def of_words(own: Column) -> Column:
        return F.struct(
            F.size(own).cast("long").alias("n_words"),
            F.length(F.array_join(own, "")).cast("long").alias("word_chars"),
            _repeated(own).cast("long").alias("n_repeat_words"),
        )

    return let(
        of_words_once(text, of_words),
        lambda own: F.struct(
            own["n_words"].alias("n_words"),
            own["word_chars"].alias("word_chars"),
            F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            repeats.cast("long").alias("n_dup_lines"),
            own["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def of_words_once(text: Column, body) -> Column:
    return let(words(text), body)


def grams(own: Column, buckets: int) -> Column:
    """Buckets of the single words and of the pairs of neighbours."""
    count = F.size(own) - 1
    pair = F.zip_with(F.slice(own, F.lit(1), count), F.slice(own, F.lit(2), count), lambda a, b: F.xxhash64(a, b))
    single = F.transform(own, lambda w: F.xxhash64(w))
    hashes = F.when(F.size(own) > 1, F.concat(single, pair)).otherwise(single)
    return F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _exploded(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """One row per n-gram of a text, and one with a null bucket for a text without words."""
    return rows.select(*keys, F.explode_outer(of_words_once(F.col("text"), lambda own: grams(own, buckets))).alias("bucket"))


def _chunked(found: Column) -> Column:
    """The buckets of a text in arrays of ``_CHUNK``; null for a text without words."""
    last = F.floor((F.size(found) - 1) / _CHUNK).cast("int")
    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(found, i * _CHUNK + 1, _CHUNK)))


def _counted(rows: DataFrame, buckets: int, sides: int) -> np.ndarray:
    """Counts by side and bucket; a column side names the side of a row. Counts are united in each task."""
    own = _exploded(rows, ["side"], buckets).where("bucket IS NOT NULL")
    found = own.groupBy((F.col("side") * F.lit(buckets) + F.col("bucket")).alias("place")).count().toArrow()
    counts = np.zeros(sides * buckets, np.int64)
    counts[found["place"].to_numpy()] = found["count"].to_numpy()
    return counts.reshape(sides, buckets)


def _ratios(good: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Logarithms of trusted counts against what their share of all lets expect, one added to both, in whole millionths."""
    expected = every * (good.sum() / max(every.sum(), 1))
    return np.rint(_UNIT * (np.log(good + 1.0) - np.log(expected + 1.0))).astype(np.int32)


def fit(
    docs: DataFrame,
    trusted: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = 1 << 18,
    steady: int = 40,
    pass_share: float = 0.9999,
    folds: int = 4,
    trusted_rows: int = 1_000_000,
) -> QualityModel:
    """Multinomials of all texts of ``docs`` and of the trusted ones among them, over hashed n-grams.

    ``trusted`` holds ids of texts known to be good. About ``trusted_rows`` of them, chosen by hash, are
    broadcast to the texts, eight bytes each, so that no text is moved to find its label; fewer are all
    taken. Every row of ``docs`` is counted, in one pass for both sides. The model has ``buckets`` numbers
    whatever the corpus; the driver receives so many counts for the corpus and for each fold of the trusted
    texts. The threshold is the mean ratio that ``pass_share`` of the trusted texts reach when the ratios
    are learned without their fold, by exact rank; texts that fail the base rules do not set it. Without
    trusted texts every ratio is 0 and all pass.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = trusted.select(F.col(doc_id).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    ids = sampled_rows(ids, F.lit(1), F.col("doc_id"), trusted_rows).select("doc_id", F.lit(True).alias("known")).limit(2 * trusted_rows)
    side = F.when(F.col("known"), F.pmod(F.xxhash64("doc_id"), F.lit(folds)) + 1).otherwise(0).cast("int")
    marked = docs.join(F.broadcast(keep(ids, "trusted")), "doc_id", "left").withColumn("side", side)
    counts = _counted(marked, buckets, folds + 1)
    good, every = counts[1:], counts.sum(axis=0)
    if not good.any():
        return QualityModel(np.zeros(buckets, np.int32) / _UNIT, -math.inf, steady)
    whole = good.sum(axis=0)
    unseen = np.concatenate([_ratios(whole - own, every) for own in good])
    # The counts are taken once, inside the condition: as columns they would be counted for every use of them.
    passes = let(base_counts(F.col("text")), lambda n: ~_failed(n["n_words"], n["n_repeat_words"]))
    # The side is part of the condition: a condition on texts alone would be tried on all of them, before the join.
    rows = marked.where(F.when(F.col("side") > 0, passes)).select((F.col("side") - 1).alias("fold"), "text", F.size(words(F.col("text"))).alias("n_words"))
    found = _scored(rows, ["fold", "n_words"], unseen, buckets, steady)
    steps = found.select(F.floor(F.col("likeness") * _STEP).alias("step"))
    least = steps.agg(F.expr(f"percentile_disc({1 - pass_share!r}) WITHIN GROUP (ORDER BY step)")).first()[0]
    return QualityModel(_ratios(whole, every) / _UNIT, -math.inf if least is None else least / _STEP, steady)


def _scored(rows: DataFrame, keys: list[str], table: np.ndarray, buckets: int, steady: int) -> DataFrame:
    """``keys``, n_words among them, and likeness of every row of a table with a column text.

    The likeness is the sum of the ratios of a text's n-grams, divided by their number and a constant that
    steadies short texts. A column fold chooses among several tables of ratios, laid end to end. The table
    reaches the workers as the value of a subquery, four bytes a bucket. N-grams are summed where they are
    made, a few to a row, so that about one row per text is shuffled; the sums are of whole numbers, whatever their order.
    """
    one = pa.table({"ratios": pa.ListArray.from_arrays(np.array([0, len(table)], np.int32), pa.array(table, pa.int32()))})
    ratios = rows.sparkSession.createDataFrame(one).scalar()
    first = F.col("fold") * F.lit(buckets) if "fold" in keys else F.lit(0)
    own = [*keys, "_key"]
    chunks = of_words_once(F.col("text"), lambda words: let(grams(words, buckets), _chunked))
    each = rows.select(*keys, F.xxhash64("text").alias("_key"), "text").select(*own, F.explode_outer(chunks).alias("chunk"))
    ratio = lambda i: F.coalesce(F.get(ratios, F.get("chunk", F.lit(i)) + first).cast("long"), F.lit(0).cast("long"))
    each = each.select(
        *own, reduce(add, map(ratio, range(_CHUNK))).alias("ratio"), F.when(F.col("chunk").isNull(), 1).otherwise(F.size("chunk")).alias("size")
    )
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    # Rows that are equal in all of this have met in one sum.
    sums = each.groupBy(*own).agg(F.sum("ratio").alias("total"), F.sum("size").alias("found"))
    copies = (F.col("found") / F.greatest(n, F.lit(1))).cast("int")
    mean = F.col("total") / copies / float(_UNIT) / (n + F.lit(steady))
    return sums.select(*keys, F.explode(F.array_repeat(F.round(mean, 9), copies)).alias("likeness"))


def judge(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the counts, base_failed, likeness and kept; other columns are ignored.

    A null or empty text has no words and fails. A text fails the base rules with fewer than ten words,
    or with more than a fifth of them in repeated windows; otherwise it is kept if its likeness reaches
    the model's threshold.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = rows.select("doc_id", "text", base_counts(F.col("text")).alias("n"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    table = np.rint(np.asarray(model.ratios) * _UNIT).astype(np.int32)
    found = _scored(counted.select("doc_id", "n.*", "text"), ["doc_id", *names], table, len(table), model.steady)
    failed = found.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))
    return failed.withColumn("kept", ~F.col("base_failed") & (F.col("likeness") >= model.threshold))


def _failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)
