import collections
import math
import random
import re

from tests.llm.conftest import prose, wide
from tidemark.llm import quality


def brute(text):
    text = text or ""
    own = re.findall("[^\x20\x09-\x0d]+", text)
    windows = collections.Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    again = {k for i in range(len(own) - 4) if windows[tuple(own[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_counts_equal_brute_force(spark, odd, odd_rows):
    texts = [t for _, t, _ in odd_rows] + ["a b c d e a b c d e f", "l1\nl1\n \nl2\n\nl1 ", "x|y #*$%&|<> z", "a a a a a", "a a a a a a", prose(7, 60) + " " + prose(7, 60)]
    docs = wide(spark, [(i, t, None) for i, t in enumerate(texts)])
    model = quality.QualityModel((0.0,) * 16, 0.0, 10)
    for row in quality.judge(docs, model).collect():
        expected = brute(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected, texts[row.doc_id]
        assert row.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert row.kept == (not row.base_failed)


def test_likeness_separates_trusted_text(spark):
    words = prose(77, 40).split()
    text = lambda seed: " ".join(random.Random(seed).choices(words, k=80))
    good = [(i, text(i), None) for i in range(80)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in text(i).split()), None) for i in range(20)]
    docs = wide(spark, good + bad)
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(None,), (5,)], "doc_id long")
    found = {r.doc_id: r.kept for r in quality.judge(docs, quality.fit(docs, trusted)).collect()}
    assert not any(found[i] for i, _, _ in bad)
    assert sum(found[i] for i, _, _ in good) >= 0.85 * len(good) and all(found[i] for i in range(40))


def test_likeness_equals_sum_of_ratios(spark):
    model = quality.QualityModel(tuple(float(i) for i in range(8)), 0.0, 4)
    docs = wide(spark, [(1, "a b", None), (2, "a", None), (3, "", None)])
    row = {r.doc_id: r.likeness for r in quality.judge(docs, model).collect()}
    bucket = lambda sql: spark.sql(f"SELECT pmod({sql}, 8L)").first()[0]
    one, pair, two = bucket("xxhash64('a')"), bucket("xxhash64(array('a', 'b'))"), bucket("xxhash64('b')")
    assert abs(row[1] - (one + two + pair) / 7) < 1e-8 and abs(row[2] - one / 5) < 1e-8 and row[3] == 0


def test_empty_tables(spark, odd, odd_rows, empty):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judge(empty, quality.fit(empty, none)).count() == 0
    rows = quality.judge(odd, quality.fit(odd, none)).collect()
    assert len(rows) == len(odd_rows) and all(r.kept == (not r.base_failed) for r in rows)


def test_junk_of_many_words_fails(spark):
    own = prose(5, 60).split()
    text = lambda seed: " ".join(random.Random(seed).choices(own, k=120))
    junk = lambda seed: " ".join(f"{seed}x{i}" for i in range(120))
    docs = wide(spark, [(i, text(i), None) for i in range(200)] + [(1000 + i, junk(i), None) for i in range(150)])
    model = quality.fit(docs, spark.createDataFrame([(i,) for i in range(100)], "doc_id long"))
    assert len(model.ratios) == 1 << 18
    found = {r.doc_id: r.kept or r.base_failed for r in quality.judge(docs, model).collect()}
    assert not any(found[1000 + i] for i in range(150)) and sum(found[i] for i in range(200)) >= 190


def test_fit_equals_brute_force(spark):
    """Ratios and threshold against plain counting; buckets come from the built-in hash."""
    own = prose(6, 30).split()
    texts = {i: " ".join(random.Random(i).choices(own, k=15 + i % 7)) if i % 4 else f"odd {i} " * 6 for i in range(60)}
    trusted, buckets, folds = [i for i in range(60) if i % 4 and i % 2], 64, 4
    docs = wide(spark, [(i, t, None) for i, t in texts.items()] + [(None, None, None)])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    of = {r.doc_id: (r.fold, r.grams) for r in rows.selectExpr(
        "doc_id", f"pmod(xxhash64(doc_id), {folds}) AS fold",
        f"transform(concat(transform(split(trim(text), ' +'), w -> xxhash64(w)), transform(sequence(1, size(split(trim(text), ' +')) - 1), i -> xxhash64(slice(split(trim(text), ' +'), i, 2)))), h -> pmod(h, {buckets}L)) AS grams").collect()}
    count = lambda ids: collections.Counter(g for i in ids for g in of[i][1])
    every = count(texts)

    def ratios(ids):
        good = count(ids)
        share = sum(good.values()) / sum(every.values())
        return [round(1e6 * (math.log(good[b] + 1) - math.log(every[b] * share + 1))) for b in range(buckets)]

    def likeness(i, table):
        return sum(table[g] for g in of[i][1]) / 1e6 / (len(of[i][1]) + 40)

    unseen = [ratios([i for i in trusted if of[i][0] != f]) for f in range(folds)]
    passing = [i for i in trusted if not (lambda n: n[0] < 10 or 100 * n[4] > 20 * n[0])(brute(texts[i]))]
    steps = sorted(math.floor(round(likeness(i, unseen[of[i][0]]), 9) * 10000) for i in passing)
    for share in (0.9999, 0.8):
        model = quality.fit(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), buckets=buckets, pass_share=share, folds=folds)
        assert [round(r * 1e6) for r in model.ratios] == ratios(trusted)
        assert model.threshold == steps[max(0, math.ceil((1 - share) * len(steps) - 1e-9) - 1)] / 10000
        for r in quality.judge(docs, model).where("doc_id IS NOT NULL").collect():
            assert abs(r.likeness - likeness(r.doc_id, ratios(trusted))) < 1e-8


def test_equal_rows_stay_apart(spark):
    docs = wide(spark, [(1, prose(1, 20), None)] * 3 + [(1, prose(2, 20), None), (None, None, None), (None, None, None)])
    assert quality.judge(docs, quality.QualityModel((1.0,) * 8, 0.0, 4)).count() == 6


def test_only_trusted_texts_are_judged_in_fit(spark, monkeypatch):
    """The base rules stand above the join with the trusted ids, not below it, where all texts would be counted."""
    plans, scored = [], quality._scored

    def noted(rows, *more):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return scored(rows, *more)

    monkeypatch.setattr(quality, "_scored", noted)
    docs = wide(spark, [(i, prose(i, 30), None) for i in range(20)])
    quality.fit(docs, spark.createDataFrame([(i,) for i in range(10)], "doc_id long"), buckets=64)
    above, below = plans[0].split("Join", 1)
    assert "array_distinct" in above and "array_distinct" not in below
