import itertools
import random
import re

import numpy as np

from tests.llm.conftest import prose, wide
from tidemark.llm import near_dedup


def shingle_set(text, n=4):
    own = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))) if own else frozenset()


def brute(rows, n=4):
    """Component of every row by position, over all pairs."""
    sets = [shingle_set(t, n) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)) if rows[i][0] is not None)


def chains(seed=4):
    """Groups of copies, edited copies, chains of edits, and texts that share half."""
    draw = random.Random(seed)
    rows = []
    for group in range(12):
        words = prose(group, 60 + 40 * (group % 3)).split()
        for _ in range(12):
            rows.append((len(rows) * 3 + 1, " ".join(words), None))
            if draw.random() < 0.6:
                words = words.copy()
                words[draw.randrange(len(words))] = prose(draw.randrange(10**6), 1)
        rows.append((len(rows) * 3 + 1, " ".join(words[: len(words) // 2]) + " " + prose(10**6 + group, 30), None))
    draw.shuffle(rows)
    return rows


def test_every_coordinate_fills_and_estimates():
    draw = np.random.default_rng(1)
    common = draw.integers(0, 2**63, 900, dtype=np.uint64)
    rows = [common, np.concatenate([common[:800], draw.integers(0, 2**63, 100, dtype=np.uint64)]), common[:1], common[:5]]
    owner = np.repeat(np.arange(4), [len(r) for r in rows])
    found = near_dedup.sketches(np.concatenate(rows), owner, 4)
    assert (found != np.iinfo(np.uint64).max).all()
    assert abs((found[0] == found[1]).mean() - 0.8) < 0.12
    for k, row in enumerate(rows):
        assert (near_dedup.sketches(row, np.zeros(len(row), np.int64), 1)[0] == found[k]).all()
    assert len(np.unique(near_dedup.band_keys(found)[2])) == near_dedup.BINS // near_dedup.BAND


def test_groups_equal_all_pairs(spark):
    rows = chains()
    found = near_dedup.link(wide(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7), (205, 201), (201, 203)]
    edges = spark.createDataFrame(path, "a long, b long")
    found = {r.node: r.component for r in near_dedup.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 201: 201, 203: 201, 205: 201}
    assert near_dedup.components(edges.limit(0)).count() == 0


def test_odd_rows(spark, odd, odd_rows, empty):
    found = near_dedup.link(odd).collect()
    assert len(found) == len(odd_rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == brute(odd_rows)
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert near_dedup.link(empty).count() == 0
    kept = near_dedup.keep_first(odd)
    expected = {c for _, _, c in brute(odd_rows, 5)}
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == expected | {None}


def test_repeated_ids_keep_the_links_of_each_row(spark):
    a, b = prose(11, 60), prose(12, 60)
    rows = [(40, a, None), (40, b, None), (45, a, None), (50, b + " end", None), (60, b + " end here", None), (61, a.upper(), None), (70, prose(13, 60), None)]
    found = near_dedup.link(wide(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)
    assert {r.doc_id: r.component_id for r in found} == {40: 40, 45: 40, 50: 40, 60: 40, 61: 40, 70: 70}


def test_bands_meet_just_above_the_limit():
    """All of 2000 pairs of similarity 0.80 to 0.85 share a band."""
    draw = np.random.default_rng(7)
    left, right = [], []
    for _ in range(2000):
        n = int(draw.integers(20, 200))
        union = draw.integers(0, 2**63, n, dtype=np.uint64)
        common = int(np.ceil(n * draw.uniform(0.80, 0.85)))
        only = (n - common) // 2
        left.append(union[: common + only])
        right.append(np.concatenate([union[:common], union[common + only :]]))
    keys = [near_dedup.band_keys(near_dedup.sketches(np.concatenate(s), np.repeat(np.arange(2000), [len(x) for x in s]), 2000)) for s in (left, right)]
    assert (keys[0] == keys[1]).any(axis=1).all()


def test_sets_are_no_keys_of_a_join(spark, odd, monkeypatch):
    """Sets are made once from the joined texts; as keys of the join they were made again for each use."""
    plans, keep = {}, near_dedup.keep

    def noted(df, label="stage"):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, label)

    monkeypatch.setattr(near_dedup, "keep", noted)
    near_dedup.link(odd).collect()
    joins = [line for line in plans["sets"].splitlines() if "Join" in line]
    assert joins and not any("xxhash64" in line for line in joins)
