import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import prose, wide
from tidemark.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, top=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    total = sum(1 for _, c in own if c)
    length = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    result = []
    for name, text in items:
        asked = terms(text)
        scored = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * total // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        result += [(name, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top])]
    return result


def check(spark, docs, items, top=20):
    rows = wide(spark, [(i, t, None) for i, t in docs])
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, score string")
    found = [tuple(r) for r in ranking.rank(rows.repartition(3), asked, top=top).collect()]
    key = lambda r: (str(r[0]), r[1], str(r[2]), r[3])
    assert sorted(found, key=key) == sorted(brute(docs, items, top), key=key)
    return found


def test_terms_equal_the_pattern():
    for text in ("Ab1-c é😀x\x00y z\u0085 A_b", "", "--", "ÀÉ straße", "a" * 50 + " " + "b" * 50):
        assert sorted(t.decode() for t in ranking.term_counts(text).elements()) == sorted(terms(text))


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranking, "_SLICE", 7)
    text = prose(4, 500)
    assert {t.decode(): n for t, n in ranking.term_counts(text).items()} == Counter(terms(text))


@pytest.mark.parametrize("postings", [40, 1 << 20])
def test_ranks_equal_brute_force(spark, monkeypatch, postings):
    monkeypatch.setattr(ranking, "_POSTINGS", postings)
    monkeypatch.setattr(ranking, "_LEAF", 3)
    draw = random.Random(5)
    own = prose(9, 60).split()
    docs = [(i, " ".join(draw.choices(own, weights=[1 / (k + 1) for k in range(60)], k=draw.randint(1, 30)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(7, docs[8][1]), (None, docs[3][1])]
    items = [(f"q{i}", " ".join(draw.choices(own, k=8))) for i in range(20)] + [("same", docs[3][1]), ("q0", "never seen"), ("none", None), ("", " - "), ("twice", f"{own[5]} {own[5]} {own[50]}")]
    found = check(spark, docs, items)
    assert len([r for r in found if r[0] == "same"]) == 20
    check(spark, docs, items[:3], top=3)


def test_odd_rows(spark, odd_rows):
    docs = [(i, t) for i, t, _ in odd_rows]
    check(spark, docs, [("a", "same OTHER text é"), ("b", prose(2, 30)), ("c", "the the")])
    check(spark, [], [("a", "text")])
    check(spark, docs, [])


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_ITEMS", 1)
    check(spark, [(i, f"word{i % 3} other") for i in range(9)], [("a", "word1"), ("b", "other word2")])


def test_bounds_hold_for_all_below():
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 30, draw.integers(1, 9))) for _ in range(500)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    names = np.empty(500, object)
    names[:] = [(-i, 0) for i in range(500)]
    trie = ranking.Trie(offsets, np.concatenate(rows), draw.integers(1, 9, offsets[-1]), draw.integers(75, 300, 500), names)
    price = draw.integers(0, 9, 30)[: len(trie.best)]
    score = np.add.reduceat(price[trie.terms] * trie.value, trie.offsets[:-1])
    leaves = []
    for node, own in enumerate(trie.children):
        if own:
            asked, value, places = trie.bounds[node]
            for bound, child in zip(np.add.reduceat(price[asked] * value, places), own):
                low, high = trie.ranges[child]
                assert bound >= score[low:high].max()
        else:
            leaves.append(trie.ranges[node])
    assert sorted(leaves)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(leaves), sorted(leaves)[1:]))
