"""Language of a text by its nearest centroid among several per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm.common import ngram_matrix, sampled_rows

UNKNOWN = "und"
_RESULT = "lang_pred string, score double, rejected boolean"


@dataclass(frozen=True)
class LanguageModel:
    """Centroids of weighted n-gram vectors; several may carry the same language."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray
    sizes: tuple[int, ...]


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def _clusters(rows: np.ndarray, wanted: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean direction, the next ones the farthest rows."""
    centres = [rows.mean(axis=0)]
    nearest = rows @ centres[0]
    while len(centres) < min(wanted, len(rows)):
        centres.append(rows[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, rows @ centres[-1])
    found = np.stack(centres)
    for _ in range(rounds):
        found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        member = np.argmax(rows @ found.T, axis=1)
        found = np.stack([rows[member == k].mean(axis=0) if (member == k).any() else found[k] for k in range(len(found))])
    return (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = 1600,
    per_language: int = 4,
    dims: int = 4096,
    sizes: tuple[int, ...] = (2, 3, 4),
) -> LanguageModel:
    """Fit centroids on at most ``sample_rows`` labelled rows, spread evenly over the languages.

    Rows with a null language, or without a letter in their text, teach nothing. Repeated rows count
    each time. The driver receives one count vector of ``dims`` numbers per sampled row.
    """
    rows = labelled.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where(F.col("_text").rlike(r"\p{L}"))
    sample = sampled_rows(rows, F.col("_lang"), F.col("_text"), sample_rows).select("_lang", "_text")

    @arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(
            [r.astype(np.uint16).tobytes() for m in ngram_matrix(texts, sizes, dims) for r in np.minimum(m, 65535)], pa.binary()
        )

    taken = sample.select("_lang", counted("_text").alias("counts")).collect()
    taken.sort(key=lambda r: (r["_lang"], bytes(r["counts"])))
    if not taken:
        return LanguageModel((), np.zeros((0, dims), np.float32), np.ones(dims, np.float32), np.zeros(0), sizes)
    counts = np.stack([np.frombuffer(r["counts"], np.uint16) for r in taken]).astype(np.float32)
    names = np.array([r["_lang"] for r in taken])
    idf = (np.log((1 + len(taken)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = _weighted(counts, idf)
    languages, centroids, reach = [], [], []
    for name in sorted(set(names.tolist())):
        own = rows[names == name]
        centres = _clusters(own, per_language)
        near = own @ centres.T
        member = near.argmax(axis=1)
        for k, centre in enumerate(centres):
            inside = near[member == k, k]
            languages.append(name)
            centroids.append(centre)
            reach.append(float(np.quantile(inside, 0.01)) if len(inside) else 1.0)
    return LanguageModel(tuple(languages), np.stack(centroids), idf, np.array(reach), sizes)


def detect(text: Column, model: LanguageModel, slack: float = 0.5) -> Column:
    """Struct (lang_pred, score, rejected) of a text column.

    ``score`` is the cosine with the nearest centroid. ``rejected`` is true where that cosine is less
    than ``slack`` times what 99 % of the centroid's training rows reach: the text lies too far from
    every language learned. A null text, one without a letter, or a model without languages gives
    ``und``, 0 and true. Ties go to the first centroid in order of language.
    """
    languages, dims = list(model.languages), model.centroids.shape[1]

    @arrow_udf(_RESULT)
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            best, cosine = [np.zeros(0, np.int64)], [np.zeros(0)]
            for counts in ngram_matrix(texts, model.sizes, dims):
                near = _weighted(counts, model.idf) @ model.centroids.T
                best.append(near.argmax(axis=1))
                cosine.append(near.max(axis=1))
            place, score = np.concatenate(best), np.clip(np.concatenate(cosine), 0, 1).astype(np.float64)
            far = score < slack * model.reach[place]
            yield pa.StructArray.from_arrays(
                [pa.array(languages).take(pa.array(place)), pa.array(score), pa.array(far)], ["lang_pred", "score", "rejected"]
            )

    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if not languages:
        return nothing
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), nearest(text)).otherwise(nothing)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", slack: float = 0.5) -> DataFrame:
    """One row (doc_id, lang_pred, score, rejected) per row of ``docs``; other columns are ignored."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), detect(F.col(text), model, slack).alias("found"))
    return rows.select("doc_id", "found.*")
