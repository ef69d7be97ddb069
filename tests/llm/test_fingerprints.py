import hashlib
import re

from tests.llm.conftest import prose, wide
from tidemark.llm import fingerprints


def shingle_set(text, n=5):
    own = re.findall("[^\x20\x09-\x0d]+", text)
    return {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_edited_texts_and_likeness(spark):
    texts = {i * 7: prose(i // 2, 150 + 20 * i) for i in range(40)} | {-5: "", 1: "few words"}
    found = fingerprints.fingerprint(wide(spark, [(i, t, None) for i, t in texts.items()])).collect()
    order = sorted(texts, reverse=True)
    following = {a: order[(k + 1) % len(order)] for k, a in enumerate(order)}
    assert len(found) == len(texts)
    for row in found:
        own, other = texts[row.doc_id], texts[following[row.doc_id]]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + other[:cut]
        assert row.n_chars == len(own) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(row.near_edited - jaccard(shingle_set(own), shingle_set(edited))) < 0.3 or len(own) < 100
        assert abs(row.near_next - jaccard(shingle_set(own), shingle_set(other))) < 0.3 or len(own) < 100
    by = {}
    for row in found:
        assert by.setdefault(texts[row.doc_id], row.fingerprint) == row.fingerprint


def test_sketches_merge_and_contain(spark):
    part, whole = prose(50, 400), prose(50, 4000)
    row = spark.createDataFrame([(part, whole, prose(51, 400))], "a string, b string, c string")
    a, b, c = (fingerprints.sketch(row[x]) for x in "abc")
    both = row.select(fingerprints.containment(a, b).alias("in"), fingerprints.containment(c, b).alias("out"), fingerprints.likeness(a, b).alias("like")).first()
    assert both["in"] > 0.95 and both["out"] < 0.05 and 0.05 < both["like"] < 0.16


def test_odd_rows(spark, odd, odd_rows, empty):
    found = fingerprints.fingerprint(odd).collect()
    assert len(found) == len(odd_rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert all(r.fingerprint == "" and r.n_chars == 0 for r in found if r.doc_id in (10, 11))
    assert len([r for r in found if r.doc_id == 21]) == 2
    assert fingerprints.fingerprint(empty).count() == 0
    alone = fingerprints.fingerprint(wide(spark, [(1, "abcdef", None)])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
