"""Expressions and small numeric helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words; every other character belongs to one.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; a null or empty text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def fold(doc_id: Column) -> Column:
    """Fold 0, 1 or 2 of a document; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def held_out(doc_id: Column) -> Column:
    """True for fold 1, which no model learns from; a null id is never held out."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def sampled_rows(rows: DataFrame, label: Column, key: Column, bound: int) -> DataFrame:
    """At most ``bound`` rows, spread evenly over the labels, chosen by the hash of ``key``.

    A label's share is a threshold on the hash, so no task sorts or gathers the rows of a label.
    Labels beyond ``bound`` (in order of frequency, then value) get no row.
    """
    marked = rows.withColumns({"_label": label, "_draw": F.pmod(F.xxhash64(key), F.lit(1 << 40))})
    marked = marked.where(F.col("_label").isNotNull())
    counts = marked.groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(bound).collect()
    if not counts:
        return marked.where(F.lit(False))
    share = bound // len(counts)
    keep = F.lit(False)
    for row in counts:
        limit = min(1.0, share / row["count"])
        keep = keep | ((F.col("_label") == F.lit(row["_label"])) & (F.col("_draw") < F.lit(int(limit * (1 << 40)))))
    return marked.where(keep)


def literal_doubles(values) -> Column:
    """A constant array of doubles that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[ord("A") : ord("Z") + 1] += 32
_LETTERS[:128][[not chr(c).isalpha() for c in range(128)]] = ord(" ")

_SLICE = 1 << 21


def ngram_matrix(texts: pa.Array, sizes: tuple[int, ...], dims: int, rows: int = 128, letters: bool = True) -> Iterator[np.ndarray]:
    """Counts of hashed byte n-grams, ``rows`` texts at a time. ``dims`` is a power of two.

    With ``letters`` ASCII letters are folded to lower case, other ASCII characters read as blanks. A long text is read in slices, so memory depends on
    neither the length of a text nor the size of the batch.
    """
    raw, places = utf8(texts)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    widest = max(sizes)
    for low in range(0, len(texts), rows):
        ends = places[low : low + rows + 1]
        counts = np.zeros((len(ends) - 1) * dims, np.float64)
        for start in range(int(ends[0]), int(ends[-1]), _SLICE):
            stop = min(start + _SLICE, int(ends[-1]))
            part = raw[start : min(stop + widest - 1, int(ends[-1]))]
            part = (_LETTERS[part] if letters else part).astype(np.uint32)
            at = np.arange(start, stop)
            owner = np.searchsorted(ends, at, side="right") - 1
            left = ends[owner + 1] - at
            code = np.zeros(stop - start, np.uint32)
            for size in range(1, widest + 1):
                n = min(stop - start, len(part) - size + 1)
                if n <= 0:
                    break
                code = code[:n] * np.uint32(257) + part[size - 1 : size - 1 + n] + np.uint32(1)
                if size in sizes:
                    whole = left[:n] >= size
                    slot = ((code[whole] + np.uint32(size)) * np.uint32(2654435761)) >> shift
                    counts += np.bincount(owner[:n][whole] * dims + slot, minlength=len(counts))
        yield counts.reshape(-1, dims).astype(np.float32)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def shingles(own: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; fewer words count as one run, none give an empty array."""
    count = F.size(own)
    runs = F.transform(F.sequence(F.lit(1), count - (size - 1)), lambda i: F.xxhash64(F.slice(own, i, size)))
    return F.when(count >= size, runs).when(count > 0, F.array(F.xxhash64(own))).otherwise(F.array().cast("array<bigint>"))


def runs(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` neighbours, there being so many, from the hashes of their halves, so that no run is copied."""
    if size == 1:
        return hashes
    count, pair = F.size(hashes) - (size - 1), lambda a, b: F.xxhash64(a, b)
    if size % 2:
        return F.zip_with(F.slice(runs(hashes, size - 1), F.lit(1), count), F.slice(hashes, F.lit(size), count), pair)
    half = size // 2
    return let(runs(hashes, half), lambda part: F.zip_with(F.slice(part, F.lit(1), count), F.slice(part, F.lit(half + 1), count), pair))
