"""Documents to piece ids: clean, without near copies, without secrets, in a chosen mixture."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_dedup, pieces, secret_scan, toxicity
from tidemark.llm.common import fold, read
from tidemark.shared import keep

#: Shares of tokens for texts labelled good and poor.
TARGETS = {"good": 0.95, "poor": 0.05}

#: No SQL expresses the learned stages; tests compare them with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 by a model of the labels of folds 0 and 2."""
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 1)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked by 0.8 of its runs of five words."""
    return near_dedup.keep_first(docs, size=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and the length counted anew."""
    clean = secret_scan.redact(docs, secret_scan.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the rates that bring good and poor texts to their shares of tokens."""
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    labels = read(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))
    model = mixing.fit(docs, labels)
    rated, _ = mixing.rates(mixing.members(docs, model), model, TARGETS, upper=1.0)
    return mixing.mix(docs, rated)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the piece ids of every document."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
