import random
import re

import numpy as np
import pytest

from tests.llm.conftest import prose, wide
from tidemark.llm import substrings
from tidemark.llm.fm_index import Bits, FMIndex, WaveletMatrix


def brute(rows):
    first = {}
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t, _ in rows]
    for (doc_id, _, _), own in zip(rows, words):
        if doc_id is not None:
            for i in range(len(own) - 12):
                key = tuple(own[i : i + 13])
                first[key] = min(first.get(key, doc_id), doc_id)
    result = []
    for (doc_id, _, _), own in zip(rows, words):
        gone = set()
        for i in range(len(own) - 12):
            if doc_id is not None and first[tuple(own[i : i + 13])] < doc_id:
                gone.update(range(i, i + 13))
        result.append((doc_id is None, doc_id or 0, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return sorted(result)


def found(docs, **options):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeated(docs, **options).collect())


def test_bits_and_wavelet_matrix():
    draw = np.random.default_rng(2)
    bits = draw.integers(0, 2, 1000).astype(np.uint8)
    assert (Bits(bits).ones(np.arange(1001)) == np.concatenate([[0], np.cumsum(bits)])).all()
    symbols = draw.integers(0, 37, 900)
    matrix = WaveletMatrix(symbols, 37)
    asked, places = draw.integers(0, 37, 500), draw.integers(0, 901, 500)
    assert (matrix.rank(asked, places) == [(symbols[:p] == s).sum() for s, p in zip(asked, places)]).all()


def test_backward_search_counts():
    draw = np.random.default_rng(3)
    text = np.concatenate([np.append(draw.integers(1, 4, n), 0) for n in (200, 30, 7, 150)])
    index = FMIndex(text, 4, 6)
    ends = np.array([e for e in range(6, len(text) + 1) if (text[e - 6 : e] > 0).all()])
    length, low, high = index.statistics(text, ends, 6)
    for e, n, a, b in zip(ends, length, low, high):
        pattern = text[e - n : e]
        assert b - a == sum((text[i : i + n] == pattern).all() for i in range(len(text) - n + 1))
        assert n == 6 or b - a == 1
        assert all((text[p : p + n] == pattern).all() for p in index.order[a:b])


def test_segments_partition_windows():
    draw = np.random.default_rng(4)
    hashes = draw.integers(0, 50, 600).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ends = np.array([0, 5, 100, 100, 113, 400, 600])
    first, count, anchor, owner = substrings.segments(hashes, ends)
    covered = sorted(w for f, c in zip(first, count) for w in range(f, f + c))
    starts = np.concatenate([[0], ends[:-1]])
    assert covered == [i for a, b in zip(starts, ends) for i in range(a, b - 12)]
    seen = {}
    for f, c, a in zip(first, count, anchor):
        for w in range(f, f + c):
            assert seen.setdefault(tuple(hashes[w : w + 13]), a) == a


@pytest.mark.parametrize("options", [{}, {"hot_least": 3}])
def test_removed_words_equal_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    draw = random.Random(6)
    passages = [prose(i, draw.randint(10, 60)) for i in range(8)]
    rows = []
    for i in range(60):
        pieces = [prose(1000 + i, draw.randint(0, 40))] + draw.choices(passages, k=draw.randint(0, 3)) + [prose(2000 + i, draw.randint(0, 20))]
        draw.shuffle(pieces)
        rows.append((i * 5 % 61, draw.choice([" ", "\n", "  "]).join(pieces), None))
    rows += [(100 + i, "the the of " * 12, None) for i in range(4)] + [(200, rows[0][1], None), (201, rows[0][1], None)]
    assert found(wide(spark, rows), **options) == brute(rows)


def test_long_texts_are_read_in_slices():
    draw = np.random.default_rng(5)
    hashes = draw.integers(0, 2**62, 500).astype(np.uint64)
    ends = np.array([40, 41, 500])
    covered = [(f + k, o) for first, count, _, owner in substrings._long_runs(hashes, ends, 64) for f, c, o in zip(first, count, owner) for k in range(c)]
    assert sorted(covered) == [(i, 0) for i in range(28)] + [(i, 2) for i in range(41, 488)]


def test_odd_rows(spark, odd, odd_rows, empty):
    assert found(odd) == brute(odd_rows)
    assert found(empty) == []
