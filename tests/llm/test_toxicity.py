import itertools
import random

import numpy as np
import pytest

from tests.llm.conftest import prose, wide
from tidemark.llm import toxicity


def brute(a, b, order, decay):
    total = 0.0
    for left in itertools.combinations(range(len(a)), order):
        for right in itertools.combinations(range(len(b)), order):
            if all(a[i] == b[j] for i, j in zip(left, right)):
                total += decay ** (left[-1] - left[0] + 1 + right[-1] - right[0] + 1)
    return total


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kernel_equals_brute_force(order):
    draw = random.Random(order)
    strings = ["".join(draw.choices("abcé", k=draw.randint(1, 9))) for _ in range(25)]
    marks = ["abcab", "cé", "bbbb"]
    expected = [[brute(s, m, order, 0.7) for m in marks] for s in strings]
    assert np.allclose(toxicity.kernel(strings, marks, order, 0.7), expected, rtol=1e-4, atol=1e-6)
    assert np.allclose(toxicity.self_kernel(strings, order, 0.7), [brute(s, s, order, 0.7) for s in strings], rtol=1e-4, atol=1e-6)


def corpus(spark, n=240):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = prose(100 + i, 40 + i % 60).split()
        toxic = int(i % 4 == 0)
        for _ in range(3 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["blockhead", "nitwit", "dumbo"]))
        rows.append((i, " ".join(words), None))
        labels.append((i, toxic))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus(spark)
    return toxicity.fit(wide(spark, rows), labels.where("doc_id % 3 <> 1"))


def test_held_out(spark, model):
    rows, labels = corpus(spark)
    found = {r.doc_id: r for r in toxicity.score(wide(spark, rows), model).collect()}
    for r in labels.where("doc_id % 3 = 1").collect():
        assert found[r.doc_id].predicted == r.toxic, found[r.doc_id]


def test_gaps_and_inserted_characters(spark, model):
    shapes = ["you blockhead you nitwit", "you b l o c k h e a d you n i t w i t", "BLOCKHEAD!! (nitwit)", "block-head nit.wit", "blockxhead nitywit"]
    rows = [(i, prose(900, 30) + " " + s, None) for i, s in enumerate(shapes)] + [(9, prose(901, 30), None)]
    found = {r.doc_id: r.score for r in toxicity.score(wide(spark, rows), model).collect()}
    assert all(found[i] > 0.5 for i in range(len(shapes))), found
    assert found[9] < 0.1


def test_odd_rows(spark, odd, odd_rows, empty, model):
    found = toxicity.score(odd, model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (10, 11, 12)}) == 1
    assert toxicity.score(empty, model).count() == 0
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.score < 0.7 for r in found)


def test_without_labels(spark, odd, empty):
    none = spark.createDataFrame([(20, None), (None, 1)], "doc_id long, toxic int")
    assert all(r.score < 1e-6 for r in toxicity.score(odd, toxicity.fit(odd, none)).collect())
    one = spark.createDataFrame([(20, 1), (21, 1)], "doc_id long, toxic int")
    assert all(r.predicted == 1 for r in toxicity.score(odd, toxicity.fit(odd, one)).collect())
    assert toxicity.score(empty, toxicity.fit(empty, one)).count() == 0
