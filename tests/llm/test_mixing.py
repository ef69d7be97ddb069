import numpy as np
import pytest

from tests.llm.conftest import prose, wide
from tidemark.llm import mixing


@pytest.fixture(scope="module")
def setting(spark):
    rows = [(i, prose(i, 30 + i % 40) if i % 3 else " ".join(w + "%%" for w in prose(i, 30 + i % 40).split()), None) for i in range(150)]
    labels = spark.createDataFrame([(i, "b" if i % 3 == 0 else "a") for i in range(0, 150, 2)] + [(None, "a"), (7, None)], "doc_id long, domain string")
    docs = wide(spark, rows)
    model = mixing.fit(docs, labels)
    return rows, docs, model, mixing.members(docs, model)


def test_posteriors_on_unlabelled_rows(setting):
    rows, _, model, members = setting
    assert model.domains == ("a", "b")
    for row in members.collect():
        assert abs(sum(row.posterior) - 1) < 1e-9 and row.n_tokens == len(rows[row.doc_id][1].split())
        if row.doc_id % 2:
            assert np.argmax(row.posterior) == (row.doc_id % 3 == 0)


def test_rates_meet_targets_as_in_numpy(setting):
    _, _, model, members = setting
    rated, totals = mixing.rates(members, model, {"a": 3.0, "b": 1.0}, rounds=60)
    table = rated.collect()
    tokens, p, rate = np.array([r.n_tokens for r in table], float), np.array([r.posterior for r in table]), np.array([r.rate for r in table])
    assert (rate >= 0).all()
    wanted = np.array([0.75, 0.25]) * tokens.sum()
    assert np.allclose((tokens * rate) @ p, wanted, rtol=1e-3)
    assert np.allclose(list(totals.values()), wanted, rtol=1e-3)
    own = np.ones(len(tokens))
    scale = 1 / ((p * tokens[:, None]).T @ p).sum(axis=1)
    for _ in range(60):
        off = (tokens * own) @ p - wanted
        if np.abs(off).max() <= 1e-6 * tokens.sum():
            break
        own = np.maximum(0, own - p @ (off * scale))
    assert np.allclose(own, rate, atol=1e-6)


def test_targets_out_of_reach_stay_nonnegative(setting):
    _, _, model, members = setting
    rated, totals = mixing.rates(members, model, {"b": 1.0, "unknown": 5.0}, rounds=60)
    assert rated.where("rate < 0").count() == 0 and totals["a"] < 0.1 * totals["b"]


def test_mix_keeps_rows_at_full_rate(setting):
    _, docs, model, members = setting
    rated, _ = mixing.rates(members, model, {"a": 1.0, "b": 0.05}, budget=1e4)
    mixed = mixing.mix(docs, rated)
    stays = {r.doc_id for r in mixed.collect()}
    assert mixed.columns == docs.columns and mixed.count() == len(stays) < 150
    assert {r.doc_id for r in rated.where("rate >= 1").collect()} <= stays
    assert stays == {r.doc_id for r in mixing.mix(docs, rated).collect()}


def test_odd_rows(spark, odd, odd_rows, empty, setting):
    _, _, model, _ = setting
    rated, _ = mixing.rates(mixing.members(odd, model), model, {"a": 1.0, "b": 1.0})
    assert rated.count() == len(odd_rows) and rated.where("rate IS NULL OR rate < 0").count() == 0
    none = mixing.fit(empty, spark.createDataFrame([], "doc_id long, domain string"))
    assert none.domains == ()
    assert mixing.rates(mixing.members(empty, model), model, {"a": 1.0})[0].count() == 0
    whole, _ = mixing.rates(mixing.members(odd, model), none, {"a": 1.0})
    assert mixing.mix(odd, whole).count() == len(odd_rows)


def test_blurred_small_domain_reaches_its_target(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(600):
        c = 0.3 + 0.1 * draw.random() if i % 30 == 0 else 0.02 * draw.random()
        b = (1 - c) * draw.random()
        rows.append((i, i, int(draw.integers(20, 400)), [1 - b - c, b, c]))
    members = spark.createDataFrame(rows, "doc_id long, row long, n_tokens long, posterior array<double>")
    model = mixing.DomainModel(("good", "poor", "toxic"), np.zeros((1, 3), np.float32))
    rated, totals = mixing.rates(members, model, {"good": 0.7, "poor": 0.29, "toxic": 0.01})
    table = rated.collect()
    tokens, p, rate = np.array([r.n_tokens for r in table], float), np.array([r.posterior for r in table]), np.array([r.rate for r in table])
    wanted = np.array([0.7, 0.29, 0.01]) * tokens.sum()
    assert (rate >= 0).all() and np.allclose((tokens * rate) @ p, wanted, rtol=1e-3)
    assert np.allclose(list(totals.values()), wanted, rtol=1e-3)


def test_kept_rows_have_the_shares(spark):
    """With an upper bound the rows that stay, not only all rates, hit the targets."""
    rows = [(i, (" ".join(w + "%%" for w in prose(i, 40).split()) if i % 5 == 0 else prose(i, 40)), None) for i in range(3000)]
    docs = wide(spark, rows)
    labels = spark.createDataFrame([(i, "b" if i % 5 == 0 else "a") for i in range(0, 3000, 3)], "doc_id long, domain string")
    model = mixing.fit(docs, labels)
    rated, totals = mixing.rates(mixing.members(docs, model), model, {"a": 0.95, "b": 0.05}, upper=1.0)
    assert rated.where("rate < 0 OR rate > 1").count() == 0
    assert abs(totals["b"] / sum(totals.values()) - 0.05) < 1e-5
    kept = [r.doc_id for r in mixing.mix(docs, rated).collect()]
    good = sum(i % 5 > 0 for i in kept)
    assert good >= 0.97 * 2400 and abs((len(kept) - good) / len(kept) - 0.05) < 0.015
