"""Secrets in a text: fixed patterns, and strings that look random to character Markov models."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, literal_doubles

# The patterns of the three base kinds and the least length of what they must find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Runs of these characters are what the models judge.
_RUN = r"[A-Za-z0-9+/_=-]{20,}"
_WORD = r"[A-Za-z0-9+/_=-]{6,}"
_KINDS = ("assign", "access", "hex", "random")
_SPAN = "array<struct<start:int,rank:int,stop:int>>"


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratio, random against ordinary, for every pair of characters in order of ALPHABET."""

    ratios: tuple[float, ...]
    threshold: float


def _spans(text: Column, pattern: str, rank: int, least: int, group: int = 0) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters, in code points, end exclusive.

    What lies between the matches gives their places; texts without a match cost one search.
    """
    between = F.transform(F.split(text, pattern), lambda s: F.length(s))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.length(s))
    judged = lengths if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s: F.length(s))
    pieces = F.zip_with(lengths, judged, lambda n, j: F.struct(n.alias("n"), j.alias("j")))

    def placed(gaps: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(_SPAN).alias("found"))

        def step(state: Column, piece: Column) -> Column:
            begin = state["at"] + F.element_at(gaps, state["k"] + 1)
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + piece["n"]).alias("stop"))
            found = F.when(piece["j"] >= least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
            return F.struct((begin + piece["n"]).alias("at"), (state["k"] + 1).alias("k"), found.alias("found"))

        return F.aggregate(pieces, start, step, lambda state: state["found"])

    return F.when(text.rlike(pattern), let(between, placed)).otherwise(F.array().cast(_SPAN))


#: The base kinds: pattern, least length, and the group of the pattern that must have it. Runs too short for hex or access are passed over by length in the pattern.
_BASE = ((ASSIGN, ASSIGN_LEAST, 2), ("AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4), ACCESS_LEAST, 0), ("[0-9a-f]{%d,}" % HEX_LEAST, HEX_LEAST, 0))


def base_spans(text: Column) -> Column:
    """Struct of the spans of each base kind."""
    return F.struct(*[_spans(text, pattern, rank, least, group).alias(_KINDS[rank]) for rank, (pattern, least, group) in enumerate(_BASE)])


def _blanked(least: int):
    return lambda m, j: F.when(F.length(j) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m)


def _without_base(text: Column) -> Column:
    """The text with blanks in place of the matches of the base kinds, so that all other characters keep their place."""
    for pattern, least, group in _BASE:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        cleared = F.zip_with(matches, judged, _blanked(least))
        parts = F.zip_with(F.split(text, pattern), cleared, lambda own, m: F.concat(own, F.coalesce(m, F.lit(""))))
        text = F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)
    return text


def _pairs(token: Column) -> Column:
    """Codes of the neighbouring characters of a token over ALPHABET."""
    size = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(
        codes, lambda own: F.transform(F.sequence(F.lit(0), F.size(own) - 2), lambda i: F.get(own, i) * size + F.get(own, i + 1))
    )


def _pair_counts(tokens: DataFrame) -> dict[int, int]:
    pairs = tokens.where(F.length("token") >= 2).select(F.explode(_pairs(F.col("token"))).alias("pair"))
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").count().collect()}


def fit(docs: DataFrame, text: str = "text", sample_rows: int = 60000, ordinary_rows: int = 4000, threshold: float = 1.0) -> SecretModel:
    """Learn both models from tokens that the base patterns label.

    Values the patterns find, in at most about ``sample_rows`` texts that hold one, are samples of random
    strings; all other tokens of about ``ordinary_rows`` texts are samples of ordinary identifiers. Texts
    are chosen by hash. Distinct tokens count once. The driver receives one count per pair of characters.
    Without any random sample no run is ever reported.
    """
    rows = docs.select(F.col(text).alias("_text")).where("_text IS NOT NULL")
    draw = F.pmod(F.xxhash64("_text"), F.lit(1 << 40))
    marks = "|".join([ASSIGN, "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"])
    totals = rows.select(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_text").rlike(marks)).alias("marked")).first()
    share = lambda bound, n: int(min(1.0, bound / max(n, 1)) * (1 << 40))
    labelled = rows.where(draw < share(sample_rows, totals["marked"])).where(F.col("_text").rlike(marks))
    values = F.concat(
        F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2)),
        F.regexp_extract_all("_text", F.lit("AKIA([A-Z0-9]{12,})"), F.lit(1)),
        F.regexp_extract_all("_text", F.lit("[0-9a-f]{32,}"), F.lit(0)),
    )
    secret = labelled.select(F.explode(values).alias("token")).where(F.length("token") >= ASSIGN_LEAST).distinct()
    plain = F.regexp_replace(F.col("_text"), marks, " ")
    ordinary = rows.where(draw < share(ordinary_rows, totals["n"])).select(F.explode(F.regexp_extract_all(plain, F.lit(_WORD), F.lit(0))).alias("token")).distinct()
    random, usual = _pair_counts(secret), _pair_counts(ordinary)
    size = len(ALPHABET)
    if not random:
        return SecretModel((0.0,) * size * size, math.inf)

    def conditional(counts: dict[int, int], a: int, b: int) -> float:
        return math.log((counts.get(a * size + b, 0) + 0.5) / (sum(counts.get(a * size + c, 0) for c in range(size)) + 0.5 * size))

    return SecretModel(tuple(round(conditional(random, a, b) - conditional(usual, a, b), 6) for a in range(size) for b in range(size)), threshold)


def _random_runs(text: Column, base: Column, model: SecretModel) -> Column:
    """Spans of runs outside the base spans whose mean ratio reaches the threshold.

    What is left of a run on either side of a base span is a run of its own if it is long enough.
    """
    if math.isinf(model.threshold):
        return F.array().cast(_SPAN)
    table = literal_doubles(model.ratios)
    free = lambda span: ~F.exists(base, lambda b: (b["start"] < span["stop"]) & (span["start"] < b["stop"]))

    def judged(left: Column) -> Column:
        def ratio(span: Column) -> Column:
            token = F.substring(left, span["start"] + 1, span["stop"] - span["start"])
            return let(_pairs(token), lambda own: F.aggregate(own, F.lit(0.0), lambda a, p: a + F.element_at(table, p + 1)) / F.size(own))

        return F.filter(_spans(left, _RUN, 3, 0), lambda span: free(span) & (ratio(span) >= model.threshold))

    return let(F.when(F.size(base) > 0, _without_base(text)).otherwise(text), judged)


def find(docs: DataFrame, model: SecretModel, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with a column ``name``: spans (start, rank, stop) by start, then kind. A null text has none."""
    own = F.coalesce(docs[text], F.lit(""))

    def joined(base: Column) -> Column:
        every = F.flatten(F.array(base["assign"], base["access"], base["hex"]))
        return let(every, lambda known: F.sort_array(F.concat(known, _random_runs(own, known, model))))

    return docs.withColumn(name, let(base_spans(own), joined))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["stop"])), ",")


def redact(docs: DataFrame, model: SecretModel, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span, overlapping ones together, replaced by ``mark``; other texts are unchanged."""

    def rewritten(spans: Column) -> Column:
        own = F.col(text)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

        def step(state: Column, span: Column) -> Column:
            gap = F.array(F.substring(own, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))
            kept = F.when(span["start"] >= state["at"], F.concat(state["kept"], gap)).otherwise(state["kept"])
            return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), kept.alias("kept"))

        rest = lambda state: F.concat(F.array_join(state["kept"], ""), F.substring(own, state["at"] + 1, F.length(own)))
        return F.aggregate(spans, start, step, rest)

    name = "_spans"
    while name in docs.columns:
        name += "_"
    found = find(docs, model, text, name)
    changed = F.when(F.size(name) > 0, rewritten(F.col(name))).otherwise(F.col(text))
    return found.withColumn(text, changed).select(docs.columns)


def report(docs: DataFrame, model: SecretModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: numbers and digest of the base spans, and all spans. Other columns are ignored."""
    found = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), model, "_text")
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
