"""Rates at which to read documents so that domains, known only by a classifier, get their share of tokens."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm.common import ngram_matrix, sampled_rows, words
from tidemark.shared import keep

_SIZES, _DIMS = (2, 3), 4096
#: Steps after which the rates are written, so that their expressions do not grow.
_WRITE = 10


@dataclass(frozen=True)
class DomainModel:
    """Softmax regression over hashed byte n-grams; the last row of the weights is the intercept."""

    domains: tuple[str, ...]
    weights: np.ndarray


def _features(counts: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.hstack([rows / np.where(length > 0, length, 1), np.ones((len(rows), 1))]).astype(np.float32)


def _softmax(scores: np.ndarray) -> np.ndarray:
    found = np.exp(scores - scores.max(axis=1, keepdims=True))
    return found / found.sum(axis=1, keepdims=True)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    domain: str = "domain",
    sample_rows: int = 2000,
    rounds: int = 300,
) -> DomainModel:
    """Learn domains from at most ``sample_rows`` rows of the labelled table, spread evenly over them.

    Their ids, so many at most, are broadcast to the texts. Rows are weighed so that each domain counts as
    often as in the whole table. Null ids and domains teach nothing; without any there are no domains.
    """
    rows = labels.select(F.col(doc_id).alias("_id"), F.col(domain).alias("_domain")).where("_id IS NOT NULL AND _domain IS NOT NULL")
    share = {r["_domain"]: r["count"] for r in rows.groupBy("_domain").count().orderBy(F.desc("count"), "_domain").limit(sample_rows).collect()}
    chosen = sampled_rows(rows, F.col("_domain"), F.col("_id"), sample_rows).select("_id", "_domain").limit(2 * sample_rows)

    @arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([r.astype(np.uint16).tobytes() for m in ngram_matrix(texts, _SIZES, _DIMS, letters=False) for r in np.minimum(m, 65535)], pa.binary())

    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    taken = sorted(texts.select("_domain", counted("_text").alias("counts")).collect(), key=lambda r: (r["_domain"], bytes(r["counts"])))
    domains = tuple(sorted({r["_domain"] for r in taken}))
    if not domains:
        return DomainModel((), np.zeros((_DIMS + 1, 0), np.float32))
    features = _features(np.stack([np.frombuffer(r["counts"], np.uint16) for r in taken]).astype(np.float32))
    label = np.array([domains.index(r["_domain"]) for r in taken])
    known = np.bincount(label, minlength=len(domains))
    weight = np.array([share[d] for d in domains]) / known
    weight = (weight / (weight * known).sum())[label]
    weights = np.zeros((features.shape[1], len(domains)))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        wrong = _softmax(features @ weights)
        wrong[np.arange(len(label)), label] -= 1
        gradient = features.T @ (wrong * weight[:, None]) + 1e-6 * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights = weights - 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return DomainModel(domains, weights.astype(np.float32))


def posteriors(text: Column, model: DomainModel) -> Column:
    """Probability of every domain, in order of the model's names; a null text is an empty one."""

    @arrow_udf("array<double>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        width = len(model.domains)
        for texts in batches:
            found = [_softmax((_features(m) @ model.weights).astype(np.float64)) for m in ngram_matrix(texts, _SIZES, _DIMS, letters=False)]
            rows = np.concatenate(found) if found else np.zeros((0, width))
            yield pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * width, pa.array(rows.ravel()))

    return judged(text)


def members(docs: DataFrame, model: DomainModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One written row (doc_id, row, n_tokens, posterior) per row of ``docs``; ``row`` is a hash of id and text."""
    own = docs.select(
        F.col(doc_id).alias("doc_id"),
        row_key(F.col(doc_id), F.col(text)).alias("row"),
        F.size(words(F.col(text))).cast("long").alias("n_tokens"),
        posteriors(F.col(text), model).alias("posterior"),
    )
    return keep(own, "members")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def rates(
    found: DataFrame,
    model: DomainModel,
    targets: dict[str, float],
    budget: float | None = None,
    upper: float | None = None,
    rounds: int = 600,
    tolerance: float = 1e-6,
) -> tuple[DataFrame, dict[str, float]]:
    """``found`` with a column rate, and the expected tokens of every domain at those rates.

    ``targets`` are shares of ``budget`` tokens (by default as many as the documents hold). The rates, which
    begin at 1 and never fall below 0, are fitted by accelerated projected gradient on the sum of squares of
    the misses, each domain's divided by its tokens. Steps are made in a row by itself, in the scale of its
    tokens; in these scales the greatest curvature is 1, so a step of 1 always leads down. Momentum starts
    anew where the sum rises. A round is one distributed sum of as many numbers as there are domains; nothing
    else reaches the driver. It ends when no total misses by ``tolerance`` of all tokens.

    With ``upper`` no rate exceeds it, the rates begin there, and the shares are of what the rates then keep,
    in place of a budget. A warning names the domains whose target is not met. A domain without a target has
    target 0. Without domains or tokens every rate is 1, or ``upper``.
    """
    width = len(model.domains)
    start = 1.0 if upper is None else upper
    p = [F.get("posterior", F.lit(k)) for k in range(width)]

    def totals(rows: DataFrame) -> np.ndarray:
        sums = rows.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * x) for x in p]).first()
        return np.array([float(x or 0) for x in sums])

    state = found.withColumns({"rate": F.lit(start), "_before": F.lit(start)})
    now = totals(state) if width else np.zeros(0)
    tokens = now.sum()
    if not tokens:
        return state.drop("_before"), {d: 0.0 for d in model.domains}
    held = np.maximum(now / start, 1e-12 * tokens)
    total = sum(w for d, w in targets.items() if d in model.domains)
    share = np.array([targets.get(d, 0.0) / max(total, 1e-12) for d in model.domains])
    fixed = tokens if budget is None else budget

    def miss(reached: np.ndarray) -> np.ndarray:
        kept = fixed if upper is None else max((share * reached / held).sum() / (share * share / held).sum(), 0.0) if share.any() else 0.0
        return reached - share * kept

    def value(reached: np.ndarray) -> float:
        return float((miss(reached) ** 2 / held).sum())

    before, speed, steps = now, 1.0, 0
    for _ in range(rounds):
        if np.abs(miss(now)).max() <= tolerance * tokens:
            break
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        push = float((speed - 1) / faster)
        slope = miss(now + push * (now - before)) / held
        ahead = F.col("rate") + F.lit(push) * (F.col("rate") - F.col("_before"))
        for x, g in zip(p, slope):
            ahead = ahead - x * F.lit(float(g))
        ahead = F.greatest(F.lit(0.0), ahead) if upper is None else F.least(F.lit(upper), F.greatest(F.lit(0.0), ahead))
        tried = state.select(*found.columns, ahead.alias("rate"), F.col("rate").alias("_before"))
        reached = totals(tried)
        if push and value(reached) > value(now):
            speed, before = 1.0, now
            state = state.withColumn("_before", F.col("rate"))
            continue
        before, now, speed, steps = now, reached, faster, steps + 1
        state = keep(tried, "rates") if steps % _WRITE == 0 else tried
    missed = [d for d, gap, s in zip(model.domains, np.abs(miss(now)), share) if gap > 1e-3 * now.sum() or gap > 0.01 * s * now.sum() + tolerance * tokens]
    if missed:
        warnings.warn(f"targets not met by any rates found: {', '.join(missed)}", stacklevel=2)
    return keep(state.drop("_before"), "rated"), dict(zip(model.domains, now.tolist()))


def mix(docs: DataFrame, rated: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, with their own columns, each at most once: a row stays with the chance of its rate.

    Take rates with an ``upper`` of 1: what stays then has the shares the rates were fitted to. The draw is a
    hash of the row, so a second run draws alike, and equal rows stay or go together.
    """
    drawn = F.pmod(F.xxhash64(F.lit("mix"), F.col("row")), F.lit(1 << 30)) / float(1 << 30)
    stays = rated.where(drawn < F.col("rate")).select(F.col("row").alias("_row")).distinct()
    return docs.join(stays, row_key(docs[doc_id], docs[text]) == stays["_row"], "left_semi")
