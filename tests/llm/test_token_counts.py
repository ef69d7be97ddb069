import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import prose, wide
from tidemark.llm import token_counts
from tidemark.shared import new_path

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library(spark, odd, odd_rows, empty, library):
    found = token_counts.count(odd, MODEL, new_path(spark, "cache"), limit=100).collect()
    size = lambda t: (len((t or "").encode()), n := len(library.encode(t or "")), n > 100)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=key) == sorted([(i, *size(t)) for i, t, _ in odd_rows], key=key)
    assert token_counts.count(empty, MODEL, new_path(spark, "cache")).count() == 0


def test_special_strings_and_the_other_library(spark):
    texts = ["<s> a </s>", "<|endoftext|> b", "x <unk>", ""]
    docs = wide(spark, [(i, t, None) for i, t in enumerate(texts)])
    own = Tokenizer.from_file(JSON)
    cache = new_path(spark, "cache")
    found = {r.doc_id: r.n_tokens for r in token_counts.count(docs, JSON, cache).collect()}
    assert found == {i: len(own.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = {r.doc_id: r.n_tokens for r in token_counts.count(docs, MODEL, cache).collect()}
    assert found == {i: len(pieces.encode(t)) for i, t in enumerate(texts)}
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_only_misses_are_encoded(spark, monkeypatch):
    cache = new_path(spark, "cache")
    docs = wide(spark, [(1, "one text", None), (2, "one text", None), (3, None, None), (4, "", None)])
    assert token_counts.count(docs, MODEL, cache).count() == 4
    assert spark.read.parquet(cache).count() == 2
    # Stored counts are believed: a mark put in the cache comes back, and a new text adds one row.
    digest = token_counts.tokenizer_digest(MODEL)
    marked = spark.range(1).select(token_counts.content_digest(F.lit("known")).alias("content"), F.lit(777).cast("long").alias("n_tokens"), F.lit(digest).alias("tokenizer"))
    marked.write.mode("append").partitionBy("tokenizer").parquet(cache)
    more = wide(spark, [(1, "known", None), (2, "new text", None), (3, "one text", None)])
    found = {r.doc_id: r.n_tokens for r in token_counts.count(more, MODEL, cache, limit=700).collect()}
    assert found[1] == 777 and spark.read.parquet(cache).count() == 4
    marked.withColumn("tokenizer", F.lit("older")).withColumn("n_tokens", F.lit(5).cast("long")).write.mode("append").partitionBy("tokenizer").parquet(cache)
    found = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts.count(more, MODEL, cache, limit=700).collect()}
    assert found[1] == (777, True)


def test_append_done_twice_changes_nothing(spark):
    cache = new_path(spark, "cache")
    docs = wide(spark, [(1, "a b", None), (2, prose(1, 50), None)])
    first = sorted(map(tuple, token_counts.count(docs, MODEL, cache).collect()))
    spark.createDataFrame(spark.read.parquet(cache).collect(), "content binary, n_tokens long, tokenizer string").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert sorted(map(tuple, token_counts.count(docs, MODEL, cache).collect())) == first


def test_long_texts_are_cut_without_a_change(library):
    for text in (prose(3, 4000), "  a  b " * 900, "ab ▁ c" * 700, "x" * 5000, ("word " * 1000), " " * 3000, "a " + "b" * 3000 + "  "):
        for size in (10, 1000):
            parts = list(token_counts.slices(text, size))
            assert " ".join(parts) == text
            assert sum(len(library.encode(p)) for p in parts) == len(library.encode(text)), text[:20]
