import re
import zlib

import numpy as np
import pyarrow as pa

from tests.llm.conftest import prose, wide
from tidemark.llm import language, queries
from tidemark.llm.common import ngram_matrix

WORDS = {"aa": "ka ro mi tu sa".split(), "bb": "lök ëj wix zuf qy".split()}


def labelled(spark, n=40):
    import random

    rows = []
    for k, (lang, parts) in enumerate(WORDS.items()):
        for i in range(n):
            draw = random.Random(1000 * k + i)
            rows.append((k * 1000 + i, " ".join("".join(draw.choices(parts, k=3)) for _ in range(5 + 3 * i)), lang))
    return rows


def test_counts_equal_brute_force():
    texts = pa.array(["Abc abc", None, "", "x" * 300, "é1é"])
    found = np.concatenate(list(ngram_matrix(texts, (2, 3), 64)))
    assert found.shape == (5, 64)
    for text, row in zip(["Abc abc", "", "", "x" * 300, "é1é"], found):
        assert row.sum() == sum(max(0, len(text.encode()) - n + 1) for n in (2, 3))
    assert (found[1] == 0).all()
    assert (np.concatenate(list(ngram_matrix(texts, (2, 3), 64, rows=2))) == found).all()


def test_held_out_and_rejection(spark):
    rows = labelled(spark)
    model = language.fit(wide(spark, rows[::2]), per_language=2)
    found = {r.doc_id: r for r in language.identify(wide(spark, rows[1::2]), model).collect()}
    assert all(found[i].lang_pred == lang and not found[i].rejected for i, _, lang in rows[1::2])
    strange = language.identify(wide(spark, [(1, "ЖЩЮ ФЫВ ЦЪЭ" * 20, None)]), model).first()
    assert strange.rejected and strange.lang_pred in WORDS


def test_odd_rows(spark, odd, odd_rows, empty):
    model = language.fit(odd)
    found = language.identify(odd, model).collect()
    assert len(found) == len(odd_rows)
    for row in found:
        assert 0 <= row.score <= 1
    by = {(r.doc_id, r.lang_pred) for r in found}
    assert {(10, "und"), (11, "und"), (12, "und")} <= by and (14, "und") not in by
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(empty)).collect()} == {"und"}


def test_query_learns_from_two_folds(spark):
    found = queries.op1_language(spark, "/root/testdata/sf0.001").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    tested = [r for r in found if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.9 * len(tested)
    assert len(found) == len(lang) and re.fullmatch("[a-z]+", found[0].lang_pred) and prose(1, 2) == prose(1, 2)
