"""Registered queries of the text operators and the statements that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, language, merkle, mixing, near_dedup, pieces, quality, ranking, secret_scan, substrings, token_counts, toxicity, warc
from tidemark.llm.common import fold, held_out, read
from tidemark.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds 0 and 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold(F.col("doc_id")) != 1))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Model learned from the labelled documents of the folds 0 and 2."""
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 1)
    return toxicity.fit(read(spark, sf_dir, "documents"), labels)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    found = toxicity.score(read(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; texts labelled as good are the target."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels").where("quality = 1"))
    return quality.judge(docs, model)


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.report(docs, secret_scan.fit(docs))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint(read(spark, sf_dir, "documents"))


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dedup.link(read(spark, sf_dir, "documents"))


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the text they decode to."""
    return pieces.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no earlier document holds in a window of thirteen."""
    found = substrings.remove_repeated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Shares of tokens the mixture gives to texts labelled good, poor and toxic.
MIX_TARGETS = {"good": 0.94, "poor": 0.05, "toxic": 0.01}


def label_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table as domains of documents."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return read(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeliest domain and reading rate of every document."""
    docs = read(spark, sf_dir, "documents")
    model = mixing.fit(docs, label_domains(spark, sf_dir))
    rated, _ = mixing.rates(mixing.members(docs, model), model, MIX_TARGETS)
    best = F.array_max("posterior")
    name = F.get(F.array(*[F.lit(d) for d in model.domains]), F.array_position("posterior", best).cast("int") - 1)
    return rated.select("doc_id", "n_tokens", name.alias("domain"), best.alias("share"), "rate")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages as read back from their archives."""
    found = warc.archive(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return ranking.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proof of every document, and whether the proof of a changed one still leads to the root."""
    return merkle.manifest(read(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, by way of a new cache: every distinct text is a miss once."""
    return token_counts.count(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache"))


ORACLES["op8_warc"] = """
    SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
           CASE WHEN strlen(payload) >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN strlen(payload) >= 1000 AND last > page_id THEN last END AS refers_to
    FROM (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
          FROM pages) AS p
"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op6_substrings"] = f"""
    WITH own AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    windows AS (
        SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS window_text
        FROM own, unnest(range(1, greatest(len(words) - 11, 1))) AS places(i)),
    firsts AS (SELECT window_text, min(doc_id) AS first_id FROM windows GROUP BY window_text),
    gone AS (
        SELECT DISTINCT doc_id, place
        FROM windows JOIN firsts USING (window_text), unnest(range(i, i + 13)) AS covered(place)
        WHERE first_id < doc_id),
    marked AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id),
    cut AS (
        SELECT own.doc_id, words, coalesce(places, []) AS places
        FROM own LEFT JOIN marked ON own.doc_id = marked.doc_id),
    kept AS (
        SELECT doc_id, len(words) AS n_words, len(places) AS n_removed,
               [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(places, i)] AS left_words
        FROM cut)
    SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(left_words, ' '), '')) AS kept_sha256 FROM kept
"""

ORACLES["op10_near_dedup"] = f"""
    WITH RECURSIVE own AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS words FROM documents),
    sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                                     ELSE [array_to_string(words[i : i + 3], ' ') FOR i IN range(1, len(words) - 2)] END) AS items
        FROM own),
    classes AS (SELECT list_sort(items) AS items, min(doc_id) AS rep, len(any_value(items)) AS n FROM sets WHERE len(items) > 0 GROUP BY list_sort(items)),
    postings AS (SELECT rep, n, unnest(items) AS item FROM classes),
    pairs AS (
        SELECT a.rep AS a, b.rep AS b, count(*) AS common, any_value(a.n) AS n_a, any_value(b.n) AS n_b
        FROM postings AS a JOIN postings AS b ON a.item = b.item AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        GROUP BY a.rep, b.rep),
    links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (n_a + n_b - common)),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT rep AS node, rep AS seen FROM classes UNION SELECT edges.b, reach.seen FROM reach JOIN edges ON reach.node = edges.a),
    roots AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
    SELECT sets.doc_id, len(sets.items) AS n_shingles, coalesce(component, sets.doc_id) AS component_id,
           coalesce(component, sets.doc_id) = sets.doc_id AS kept
    FROM sets LEFT JOIN classes ON list_sort(sets.items) = classes.items LEFT JOIN roots ON roots.node = classes.rep
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op11_ranking"] = f"""
    WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS terms FROM documents),
    sizes AS (SELECT count(*) AS total, sum(len(terms))::BIGINT AS length FROM docs WHERE len(terms) > 0),
    held AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs),
    tfs AS (SELECT r, doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
    asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM tfs, sizes WHERE term IN (SELECT term FROM asked) GROUP BY term),
    parts AS (
        SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // length))) AS part
        FROM tfs JOIN weights USING (term), sizes),
    scores AS (SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL),
    ranked AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank, doc_id, score
        FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')])),
                        lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))"""


def _encoded(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _climb(tree: str, start: str, name: str, levels: int = 8) -> str:
    """Levels of trees named by ``tree`` and, for every row of ``start`` (row, tree, k, n, folded, proof), its way to their root.

    A tree of one node is carried along unchanged; eight levels hold 16^8 leaves.
    """
    steps = []
    for i in range(levels):
        below, rows = f"{name}_{i}", f"{name}_way_{i}"
        steps.append(f"""{name}_runs_{i} AS (SELECT {tree}, k // 16 AS run, n, list(hash ORDER BY k) AS hashes FROM {below} GROUP BY ALL),
    {name}_{i + 1} AS (SELECT {tree}, run AS k, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hashes, '')) ELSE hashes[1] END AS hash FROM {name}_runs_{i}),
    {name}_way_{i + 1} AS (
        SELECT w.* EXCLUDE (k, n, folded, proof), w.k // 16 AS k, (w.n + 15) // 16 AS n,
               CASE WHEN w.n > 1 THEN sha256(coalesce(array_to_string(hashes[: w.k % 16], ''), '') || folded || coalesce(array_to_string(hashes[w.k % 16 + 2 :], ''), '')) ELSE folded END AS folded,
               CASE WHEN w.n > 1 THEN proof || coalesce(array_to_string(hashes[: w.k % 16], ''), '') || coalesce(array_to_string(hashes[w.k % 16 + 2 :], ''), '') ELSE proof END AS proof
        FROM {rows} AS w JOIN {name}_runs_{i} AS r ON r.{tree} = w.{tree} AND r.run = w.k // 16)""")
    return f"{name}_way_0 AS ({start}),\n    " + ",\n    ".join(steps)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_TAMPERED = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", _LOWERED))

ORACLES["op12_manifest"] = f"""
    WITH leaves AS (
        SELECT doc_id, source, sha256({_LEAF}) AS leaf,
               CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND xor({_CRC}, 4294967295) % 5 = 0 THEN sha256({_TAMPERED}) END AS tampered
        FROM documents),
    placed AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k,
               count(*) OVER (PARTITION BY source) AS n
        FROM leaves),
    inner_0 AS (SELECT src, k, n, leaf AS hash FROM placed),
    {_climb("src", "SELECT doc_id, leaf, src, k, n, coalesce(tampered, leaf) AS folded, '' AS proof FROM placed", "inner")},
    outer_0 AS (SELECT 0 AS top, src AS k, (SELECT count(*) FROM inner_8) AS n, hash FROM inner_8),
    {_climb("top", "SELECT doc_id, leaf, src, 0 AS top, src AS k, (SELECT count(*) FROM inner_8) AS n, folded, proof FROM inner_way_8", "outer")}
    SELECT w.doc_id, w.leaf, s.hash AS subroot, r.hash AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.hash AS verified
    FROM outer_way_8 AS w JOIN inner_8 AS s ON s.src = w.src, outer_8 AS r
"""
