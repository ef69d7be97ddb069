"""Toxicity of a text by a support vector machine over a gapped subsequence kernel.

Two strings are alike when they share short subsequences; each character that a shared subsequence
skips, in either string, costs a factor. An insult with dots, spaces or letters put between its own
therefore stays close to the plain one. The kernel is evaluated only against a few landmark strings
(Nyström), which makes the machine linear in the landmark features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm.common import sampled_rows, words
from tidemark.shared import keep

LONGEST = 32
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
#: Weight of all ordinary words together, against 1 for all insults.
_ORDINARY = 20.0
_FLOOR = -0.5
_KNOWN = 120_000
_CHUNK = 1 << 20
#: Words a worker has judged, by model: all of them, and the margins of those above the floor.
_JUDGED: dict[bytes, tuple[set[str], dict[str, float]]] = {}


def plain(token: str) -> str:
    """Lower-case token without punctuation at its ends."""
    token = token.lower()
    return token if token.isalnum() else _EDGES.sub("", token)


def parts(token: str) -> set[str]:
    """The token and its letters and digits alone, in half-overlapping pieces where longer than ``LONGEST``."""
    if len(token) <= LONGEST and token.isalnum():
        return {token}
    forms = {token, _INSIDE.sub("", token)}
    return {f[i : i + LONGEST] for f in forms for i in range(0, max(1, len(f) - LONGEST // 2), LONGEST // 2)}


def _codes(strings: list[str]) -> np.ndarray:
    width = max([1, *map(len, strings)])
    return np.array(strings, f"U{width}").view(np.uint32).reshape(len(strings), width).astype(np.int64)


#: Strings whose kernels are computed together.
_ROWS = 2048


def kernel(strings: list[str], landmarks: list[str], order: int, decay: float) -> np.ndarray:
    """Gap-weighted count of common subsequences of ``order`` characters, strings by landmarks.

    ``state[q, j]`` sums, over what is read of a string, the common subsequences of q + 1 characters
    that end at place j of the landmark. Gaps in the string are paid by a factor of its place, applied
    when a subsequence begins and when it ends.
    """
    left, right = _codes(strings), _codes(landmarks)
    width = right.shape[1]
    letters = np.unique(right[right > 0])
    codes = np.minimum(np.searchsorted(letters, left), len(letters) - 1)
    place = np.where(letters[codes] == left, codes, len(letters))
    match = np.zeros((width, len(letters) + 1, len(landmarks)), np.float32)
    for j in range(width):
        match[j, :-1] = letters[:, None] == right[None, :, j]
    decay = np.float32(decay)
    total = np.zeros((len(strings), len(landmarks)), np.float32)
    for low in range(0, len(strings), _ROWS):
        rows = place[low : low + _ROWS]
        found = total[low : low + _ROWS]
        state = np.zeros((order - 1, width, *found.shape), np.float32)
        run, fresh = np.empty_like(found), np.empty_like(found)
        for i in range(left.shape[1]):
            hits = match[:, rows[:, i]]
            for q in range(order - 1, 0, -1):
                run[:] = 0
                ended = np.zeros_like(found) if q == order - 1 else None
                for j in range(q, width):
                    run *= decay
                    run += state[q - 1, j - 1]
                    np.multiply(hits[j], run, out=fresh)
                    if ended is None:
                        state[q, j] += fresh
                    else:
                        ended += fresh
                if ended is not None:
                    ended *= decay ** np.float32(i + order + 1)
                    found += ended
            hits *= decay ** np.float32(-i)
            state[0] += hits
    return total


def self_kernel(strings: list[str], order: int, decay: float) -> np.ndarray:
    """Kernel of every string with itself, scaled as in ``kernel``."""
    codes = _codes(strings)
    n, width = codes.shape
    decay = np.float32(decay)
    result = np.zeros(n, np.float32)
    for low in range(0, n, _ROWS):
        own = np.ascontiguousarray(codes[low : low + _ROWS].T)
        alike = ((own[:, None] == own[None]) & (own[:, None] > 0)).astype(np.float32)
        state = np.zeros((order - 1, width, own.shape[1]), np.float32)
        found = result[low : low + _ROWS]
        for i in range(width):
            for q in range(order - 1, 0, -1):
                run = np.zeros(own.shape[1], np.float32)
                for j in range(q, width):
                    run *= decay
                    run += state[q - 1, j - 1]
                    if q == order - 1:
                        found += alike[i, j] * run * decay ** np.float32(i + order + 1)
                    else:
                        state[q, j] += alike[i, j] * run
            state[0] += alike[i] * decay ** np.float32(-i)
    return result


@dataclass(frozen=True)
class ToxicityModel:
    """Landmarks, weights of the landmark kernels, and the logistic curve over the sum of a text's two highest margins."""

    landmarks: tuple[str, ...]
    weights: np.ndarray
    bias: float
    curve: tuple[float, float]
    order: int = 3
    decay: float = 0.7

    def margins(self, strings: list[str]) -> np.ndarray:
        return _features(strings, list(self.landmarks), self.order, self.decay) @ self.weights + self.bias


def _features(strings: list[str], landmarks: list[str], order: int, decay: float) -> np.ndarray:
    """Normalised kernel rows; strings of like length are computed together."""
    result = np.zeros((len(strings), len(landmarks)), np.float32)
    if not landmarks:
        return result
    scale = np.sqrt(self_kernel(landmarks, order, decay))
    lengths = np.array([len(s) for s in strings], np.int64)
    for low, high in ((order, 6), (7, 10), (11, 14), (15, 20), (21, LONGEST)):
        chosen = np.flatnonzero((lengths >= low) & (lengths <= high))
        if len(chosen):
            group = [strings[i] for i in chosen]
            own = np.sqrt(np.maximum(self_kernel(group, order, decay), 1e-12))
            result[chosen] = kernel(group, landmarks, order, decay) / own[:, None] / scale[None, :]
    return result


def _machine(features: np.ndarray, sign: np.ndarray, cost: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps; the last column of the solution is the bias."""
    rows = np.hstack([features, np.ones((len(features), 1))]).astype(np.float64)
    weights = np.zeros(rows.shape[1])
    penalty = np.eye(rows.shape[1]) * ridge
    penalty[-1, -1] = 1e-9
    for _ in range(30):
        short = sign * (rows @ weights) < 1
        used, c = rows[short], cost[short]
        new = np.linalg.solve(used.T @ (used * c[:, None]) + penalty, used.T @ (c * sign[short]))
        if np.allclose(new, weights, atol=1e-8):
            break
        weights = new
    return weights[:-1], float(weights[-1])


def _logistic(values: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by damped Newton steps."""
    rows = np.stack([values, np.ones(len(values))], axis=1)
    curve = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ curve, -30, 30)))
        gradient = rows.T @ (weight * (p - label)) + 1e-3 * curve
        hessian = rows.T @ (rows * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        curve = curve - step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(curve[0], 0.0)), float(curve[1])


def _stems(token: Column) -> Column:
    """The token and its beginnings of four to eight characters."""
    starts = F.transform(F.sequence(F.lit(4), F.lit(8)), lambda n: F.when(n < F.length(token), F.substring(token, F.lit(1), n)))
    return F.array_union(F.array(token), F.array_compact(starts))


def _without_near_copies(sample: DataFrame, bands: int = 3, band: int = 2) -> DataFrame:
    """Drop texts that agree with a kept one of the same label in all ``band`` minimum hashes of one of ``bands``.

    Groups of near copies would make every word of theirs look as if it followed the label. Hashes are of
    word pairs; texts that differ in label are never united.
    """
    own = F.transform(words(F.col("_text")), lambda w: F.xxhash64(w))
    pairs = F.when(F.size(own) > 1, F.zip_with(F.slice(own, F.lit(1), F.size(own) - 1), F.slice(own, F.lit(2), F.size(own) - 1), lambda x, y: F.xxhash64(x, y))).otherwise(own)
    marked = sample.withColumn("_pairs", pairs)
    least = lambda k: F.coalesce(F.array_min(F.transform("_pairs", lambda x: F.xxhash64(x, F.lit(k)))), F.lit(0))
    for b in range(bands):
        marked = marked.withColumn(f"_band{b}", F.xxhash64(*[least(b * band + k) for k in range(band)]))
    marked = marked.drop("_pairs")
    for b in range(bands):
        first = marked.groupBy(f"_band{b}", "_y").agg(F.min_by(F.struct("_text", *[f"_band{i}" for i in range(b + 1, bands)]), F.xxhash64("_text")).alias("_row"))
        marked = first.select("_y", "_row.*")
    return marked


def _spread(strings: list[str], wanted: int, order: int, decay: float) -> list[str]:
    """The first ``wanted`` strings, without those much like an earlier one."""
    alike = _features(strings, strings, order, decay)
    chosen: list[int] = []
    for limit in (0.6, 0.9):
        for i in range(len(strings)):
            if len(chosen) < wanted and i not in chosen and not (alike[i, chosen] > limit).any():
                chosen.append(i)
    return [strings[i] for i in sorted(chosen)]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = 8000,
    positive_units: int = 400,
    ordinary_units: int = 12000,
    landmarks: int = 24,
    order: int = 3,
    decay: float = 0.7,
) -> ToxicityModel:
    """Learn from at most ``sample_rows`` labelled texts, half of each label, chosen by the hash of their id.

    The chosen ids, so many at most, are broadcast to the texts; no text is shuffled to find its label.
    Texts carry the label, words do not: a word counts as an insult if it, or its beginning, occurs in
    more texts of label 1 than chance would bring about once among the square of the number of words that
    are seen twice. No word that passes is dropped for being rarer than others. The counting is distributed; at most
    ``positive_units`` insults and ``ordinary_units`` words of label-0 texts reach the driver. Near
    copies count once. Null texts and labels teach nothing. Without texts of both labels, or without
    insults, every text scores the share of label 1 (0 if there are no labels).
    """
    rows = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    totals = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    seen = sum(totals.values())
    share = totals.get(1, 0) / seen if seen else 0.0
    nothing = ToxicityModel((), np.zeros(0), 0.0, (0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))), order, decay)
    if len(totals) < 2:
        return nothing
    chosen = sampled_rows(rows, F.col("_y"), F.col("_id"), sample_rows).select("_id", "_y").limit(2 * sample_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    sample = keep(_without_near_copies(texts.join(F.broadcast(chosen), "_id").select("_text", "_y")), "labelled")
    counts = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    if not bad or not good:
        return nothing
    token = F.regexp_replace(F.lower(F.col("word")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    units = keep(
        sample.select("_y", F.explode(F.array_distinct(words(F.col("_text")))).alias("word"))
        .groupBy(token.alias("word"))
        .agg(F.sum("_y").alias("bad"), F.sum(1 - F.col("_y")).alias("good"))
        .where(F.length("word").between(order, LONGEST)),
        "words",
    )
    stems = units.select(F.explode(_stems(F.col("word"))).alias("stem"), "bad", "good").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    telling = 15 * (F.col("good") + 0.5) / good < F.col("bad") / bad
    a, b = F.col("bad") + 0.0, F.col("good") + 0.0
    expected_a, expected_b = (a + b) * (bad / (bad + good)), (a + b) * (good / (bad + good))
    surprise = 2 * (F.when(a > 0, a * F.log(a / expected_a)).otherwise(0.0) + F.when(b > 0, b * F.log(b / expected_b)).otherwise(0.0))
    repeated = max(units.where(F.col("bad") + F.col("good") > 1).count(), 2)
    found = stems.where((F.length("stem") >= 4) & telling & (surprise > 4 * float(np.log(repeated))))
    ranked = found.select("stem", "bad", "good", surprise.alias("surprise")).orderBy(F.desc("surprise"), "stem").limit(positive_units).collect()
    starts = {r["stem"] for r in ranked}
    if not starts:
        return nothing
    carried = F.arrays_overlap(_stems(F.col("word")), F.array(*[F.lit(s) for s in sorted(starts)])) & telling
    insults = units.where(carried).orderBy(F.desc("bad"), "word").limit(positive_units).collect()
    ordinary = units.where((F.col("good") > 0) & ~carried)
    frequent = ordinary.orderBy(F.desc("good"), "word").limit(ordinary_units // 2).collect()
    drawn = ordinary.orderBy(F.xxhash64("word"), "word").limit(ordinary_units // 2).collect()
    positive = [r["word"] for r in insults]
    negative = sorted({r["word"] for r in [*frequent, *drawn]})
    if not positive or not negative:
        return nothing
    weight = {r["word"]: float(r["bad"]) for r in insults} | {r["word"]: float(r["good"]) for r in [*frequent, *drawn]}
    sign = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    often = np.sqrt([weight[w] for w in [*positive, *negative]])
    # Each insult counts by the root of its texts, each ordinary word by its texts: a common word taken for an insult spoils many texts.
    cost = np.where(sign > 0, often / often[sign > 0].sum(), _ORDINARY * often**2 / (often[sign < 0] ** 2).sum())
    telling_stems = sorted(ranked, key=lambda r: (-round(r["surprise"], 6), -len(r["stem"]), r["stem"]))
    longest: list[str] = []
    for r in telling_stems:
        if not any(r["stem"].startswith(s) or s.startswith(r["stem"]) for s in longest):
            longest.append(r["stem"])
    marks = _spread(longest, landmarks * 2 // 3, order, decay)
    for _ in range(2):
        inner = _features(marks, marks, order, decay).astype(np.float64)
        value, vector = np.linalg.eigh((inner + inner.T) / 2)
        root = vector @ np.diag(np.where(value > 1e-4, 1 / np.sqrt(np.maximum(value, 1e-4)), 0)) @ vector.T
        features = np.vstack([_features(positive, marks, order, decay), _features(negative, marks, order, decay)]) @ root
        weights, bias = _machine(features, sign, cost, ridge=1e-4)
        wrong = (features[sign < 0] @ weights + bias + 1) * often[sign < 0]
        hardest = [negative[i] for i in np.argsort(-wrong)[:100]]
        if len(marks) < landmarks:
            marks = marks + _spread([w for w in hardest if w not in marks], landmarks - len(marks), order, decay)
        else:
            break
    model = ToxicityModel(tuple(marks), (root @ weights).astype(np.float32), bias, (1.0, 0.0), order, decay)
    seen = sample.select("_y", highest(F.col("_text"), model).alias("m")).select("_y", "m.*").collect()
    values = np.array([r["first"] + r["second"] for r in seen])
    label = np.array([r["_y"] for r in seen], float)
    weight = np.where(label == 1, share / bad, (1 - share) / good) * len(seen)
    return ToxicityModel(model.landmarks, model.weights, model.bias, _logistic(values, label, weight), order, decay)


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in runs of about ``_CHUNK`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t.as_py() or "")
        size += len(run[-1])
        if size >= _CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def highest(text: Column, model: ToxicityModel) -> Column:
    """Struct (first, second): the two highest word margins of a text, between a fixed floor and 1.

    Words are judged once per worker and remembered; the memory is bounded. Single characters that
    stand apart, three or more in a row, are read as one word too.
    """

    key = model.weights.tobytes() + "\n".join(model.landmarks).encode()

    @arrow_udf("first double, second double")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _JUDGED:
            _JUDGED.clear()
            _JUDGED[key] = set(), {}
        known, telling = _JUDGED[key]
        for texts in batches:
            first, second = [], []
            for rows in _chunks(texts):
                tokens = [t.split() for t in rows]
                for own, row in zip(tokens, rows):
                    own += [s.replace(" ", "") for s in _SPACED.findall(row)]
                fresh = list(set().union(*tokens) - known)
                pieces = [(t, p) for t in fresh for p in parts(plain(t)) if len(p) >= model.order]
                shapes = sorted({p for _, p in pieces})
                margin = dict(zip(shapes, model.margins(shapes).tolist()))
                for t, p in pieces:
                    if margin[p] > _FLOOR:
                        telling[t] = min(max(margin[p], telling.get(t, _FLOOR)), 1.0)
                known.update(fresh)
                for own in tokens:
                    found = sorted([telling[t] for t in own if t in telling], reverse=True)[:2] + [_FLOOR, _FLOOR]
                    first.append(found[0])
                    second.append(found[1])
                if len(known) > _KNOWN:
                    for t in list(known)[_KNOWN // 2 :]:
                        known.discard(t)
                        telling.pop(t, None)
            yield pa.StructArray.from_arrays([pa.array(first, pa.float64()), pa.array(second, pa.float64())], ["first", "second"])

    return judged(F.coalesce(text, F.lit("")))


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """Score from 0 to 1, higher where label 1 is likelier. A null or empty text is scored as a text without insults."""
    steep, base = model.curve
    if not model.landmarks:
        return F.lit(float(1 / (1 + np.exp(-base))))
    found = highest(text, model)
    return 1 / (1 + F.exp(-((found["first"] + found["second"]) * steep + base)))


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row (doc_id, score, predicted) per row of ``docs``; other columns are ignored."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), toxicity(F.col(text), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs``, with their own columns, that score under ``threshold``."""
    return docs.where(toxicity(docs[text], model) < threshold)
