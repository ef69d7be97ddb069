"""Token counts with a cache of digests: every distinct text is encoded once per tokenizer, ever."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.shared import keep

CACHE = "content binary, n_tokens bigint, tokenizer string"
BLANK = "▁"
#: Characters given to the library at once, and the length from which a text is cut at a blank.
_RUN, _LONG = 1 << 18, 1 << 20


@lru_cache(maxsize=4)
def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it, with its version."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    name = f"{library.__name__} {library.__version__}\n".encode()
    return hashlib.sha256(name + Path(path).read_bytes()).hexdigest()


@lru_cache(maxsize=2)
def _library(path: str):
    if path.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return own
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    own.cuts = not any(BLANK in own.id_to_piece(i).lstrip(BLANK) for i in range(own.get_piece_size())) and own.normalize(" a  Åﬁ ") == f"{BLANK}{BLANK}a{BLANK}{BLANK}Åﬁ{BLANK}"
    return own


def slices(text: str, size: int = _LONG) -> Iterator[str]:
    """Parts of a text that a vocabulary of word pieces encodes one by one as it would the whole.

    Such a vocabulary puts a blank before what it is given, and no piece reaches over a blank that follows
    another character, so a text may be cut there if the blank itself is left out.
    """
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and (text[cut - 1] in (" ", BLANK)):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 == len(text):
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def counts(texts: list[str], path: str) -> list[int]:
    """Tokens of every text as the library gives them, without begin, end or added special tokens."""
    library = _library(path)
    if path.endswith(".json"):
        return [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    if not library.cuts:
        return [len(ids) for ids in library.encode(texts, num_threads=1)]
    parts = [list(slices(t)) if len(t) > _LONG else [t] for t in texts]
    return [sum(len(library.encode(p)) for p in own) if len(own) > 1 else len(library.encode(own[0])) for own in parts]


def count_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text; a null text is an empty one."""

    @arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found, run, held = [], [], 0
            for text in texts:
                run.append(text.as_py() or "")
                held += len(run[-1])
                if held >= _RUN:
                    found += counts(run, path)
                    run, held = [], 0
            yield pa.array(found + counts(run, path) if run else found, pa.int64())

    return counted(text)


def read_cache(spark: SparkSession, cache: str, path: str) -> DataFrame:
    """Stored counts (content, n_tokens) of one tokenizer version, one row per content; none if there is no cache yet.

    Two runs that append at once may store a content twice, with the same count.
    """
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    own = stored.where(F.col("tokenizer") == tokenizer_digest(path))
    return own.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def content_digest(text: Column) -> Column:
    """Digest of the normalised content: null becomes empty, and nothing else may change without changing counts."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def count(docs: DataFrame, path: str, cache: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``; other columns are ignored.

    ``cache`` is a shared folder of counts by digest of content and tokenizer version. The digests of all
    rows are joined with it; contents it lacks are encoded once each, however many rows hold them, and
    appended before the counts are joined back. A lost executor repeats its part of the encoding only;
    a run that dies half-way leaves nothing or a whole append. Copies are united in each task before their
    text is moved, and where all contents are known no text is moved at all. Null and empty texts have no tokens, repeated
    rows and ids stay apart.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digests = keep(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("content")), "digests")
    asked = digests.groupBy("content").agg(F.count(F.lit(1)).alias("copies"))
    misses = keep(asked.join(read_cache(spark, cache, path), "content", "left_anti").select("content"), "misses")
    if not misses.isEmpty():
        distinct = rows.select(content_digest(F.col("text")).alias("content"), "text").dropDuplicates(["content"])
        fresh = distinct.join(misses, "content", "left_semi").select("content", count_tokens(F.col("text"), path).alias("n_tokens"))
        fresh.withColumn("tokenizer", F.lit(tokenizer_digest(path))).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # Kept, so that Spark knows its size when it plans the join with the rows.
    known = keep(read_cache(spark, cache, path).join(asked.select("content"), "content", "left_semi"), "counts")
    found = digests.join(known, "content", "left")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
