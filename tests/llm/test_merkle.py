import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose, wide
from tidemark.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def ascend(hashes):
    """Root of the hashes, and for each the siblings on its way, each with what comes before and after."""
    ways = [[] for _ in hashes]
    owners = [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        above, held = [], []
        for low in range(0, len(hashes), 16):
            run = hashes[low : low + 16]
            for j in range(len(run)):
                for i in owners[low + j]:
                    ways[i].append((run[:j], run[j + 1 :]))
            above.append(sha(*run))
            held.append(sum(owners[low : low + 16], []))
        hashes, owners = above, held
    return hashes[0], ways


def brute(rows):
    """(doc_id, source, lang, n_chars, text) to result rows."""
    leaf = lambda r: sha(*map(part, r))
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops, kept = [], []
    for s in order:
        own = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, ways = ascend([leaf(r) for r in own])
        tops.append(top)
        kept.append((own, ways))
    root, outer = ascend(tops)
    result = []
    for top, (own, ways), beyond in zip(tops, kept, outer):
        for r, way in zip(own, ways):
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            folded = leaf((*r[:4], r[4].translate(LOWER))) if struck else leaf(r)
            proof = ""
            for before, after in way + beyond:
                folded = sha(*before, folded, *after)
                proof += "".join(before + after)
            result.append((r[0], leaf(r), top, root, sha(proof), folded, folded == root))
    return result


def frame(spark, rows):
    return wide(spark, []).sparkSession.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"tree": F.lit("x"), "hash": F.lit(1), "up": F.lit(None), "source_": F.lit(2)})


def check(spark, rows):
    found = sorted(map(tuple, merkle.manifest(frame(spark, rows)).collect()), key=str)
    assert found == sorted(brute(rows), key=str)
    return found


@pytest.mark.parametrize("sizes", [(1,), (17,), (300, 1, 16, 17), tuple([1, 2] * 20)])
def test_trees_equal_brute_force(spark, sizes):
    rows, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i := i + 7, None if s == 1 else f"é{s}" if s % 2 else f"S{s}", "en", i % 9 or None, prose(i, 3).title()))
    found = check(spark, rows)
    assert len({r[3] for r in found}) == 1
    if sum(sizes) > 50:
        assert {r[6] for r in found} == {True, False}


def test_copied_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPREAD", 3)
    check(spark, [(i, "hot" if i % 3 else f"s{i % 7}", None, 1, f"Text {i}") for i in range(700)])


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "", 0, ""), (5, "", "", 0, ""), (5, "", "", 1, "Other"), (7, "a:b", "-", -3, "é😀 ABC"), (8, "b", None, 2, "x" * 200000)]
    found = check(spark, rows)
    assert len(found) == len(rows)
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_a_change_is_noticed(spark):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(40)]
    before = merkle.manifest(frame(spark, rows)).first().root
    assert merkle.manifest(frame(spark, list(reversed(rows)))).first().root == before
    assert merkle.manifest(frame(spark, [*rows[:-1], (39, "s", "en", 1, "text 39")])).first().root != before


def test_digests_travel_as_bytes(spark, monkeypatch):
    """What climbs is half as wide as text, and a digest that several leaves share climbs once."""
    kept, keep = {}, merkle.keep

    def noted(df, label):
        kept[label] = keep(df, label)
        return kept[label]

    monkeypatch.setattr(merkle, "keep", noted)
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(16)]
    assert len(check(spark, rows)) == 16
    changed = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(16))
    climbed = kept["climbed"].first()
    assert len(climbed["folded"]) == changed + 1 and {type(x) for x in climbed["folded"]} <= {bytes, bytearray}
    assert dict(kept["leaves"].dtypes)["leaf"] == "binary"
