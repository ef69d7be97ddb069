from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.models import attribution, learners, proxy, search
from tidemark.plans import train


@pytest.fixture(scope="module")
def fold(spark):
    rng = np.random.default_rng(42)
    n = 600
    x = rng.normal(size=(n, 4))
    label = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.5, n) > 1).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(label=label, player_id=[f"p{i}" for i in range(n)], fold=1)
    pdf["split"] = np.where(np.arange(n) < 400, "train", np.where(np.arange(n) < 500, "val", "test"))
    rows = spark.createDataFrame(pdf).withColumn("c", F.when(F.col("c") < 2, F.col("c")))
    return train.load_fold(rows, 1)


@pytest.fixture(scope="module")
def model(fold):
    shape = {"max_leaves": 0, "max_depth": 3, "rate": 0.2}
    return learners.train_boosted(fold[1]["train"], fold[1]["val"], shape, 6)


def margin(model, df):
    return model.transform(df).select("player_id", "margin").toPandas().set_index("player_id").margin


def test_inputs(fold):
    inputs, splits = fold
    assert inputs.features == list("abcd") and splits["train"].count() == 400
    assert splits["train"].where("c is null").count() == 0


def test_learners_rank(fold, model):
    test = fold[1]["test"]
    from tidemark.operators.evaluate import roc_auc

    for fitted in (model, learners.train_baseline(fold[1]["train"])):
        auc = roc_auc(learners.with_probability(fitted, test, "p"), [], score="p").first()[0]
        assert 0.85 < auc <= 1


def test_baseline_is_the_minimum_of_its_objective(spark):
    """The penalised, balanced loss in numpy has no gradient at the fitted coefficients."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + rng.normal(0, 1, 200) > 0.8).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(label=y.astype(int)))
    fitted = learners.train_baseline(learners.Inputs(["a", "b"], {}).transform(df))
    scaler, lr = fitted.stages
    z = (x - scaler.mean.toArray()) / scaler.std.toArray()
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    p = 1 / (1 + np.exp(-(z @ lr.coefficients.toArray() + lr.intercept)))
    gradient = (z * (w * (p - y))[:, None]).sum(0) / w.sum() + lr.coefficients.toArray() / 200
    assert np.abs(gradient).max() < 1e-3


def test_class_weight(frame):
    df = frame([(0,)] * 9 + [(1,)] * 3, "label int")
    assert learners.positive_weight(df) == 3.0 and learners.positive_weight(df, 10) == 10.0
    assert learners.positive_weight(df.where("label = 0")) == 1.0


def test_contributions_add_up(fold, model):
    test = fold[1]["test"]
    parts = attribution.explain(model, test, ["player_id"], list("abcd")).toPandas()
    total = parts.groupby("player_id").contribution.sum() + parts.groupby("player_id").base_value.first()
    expected = margin(model, test)
    np.testing.assert_allclose(total.sort_index(), expected.sort_index(), atol=1e-9)


def test_shapley_against_all_coalitions():
    """Leaves of one tree on three features; every coalition is tried."""
    leaves = [
        (1.0, [(0, -np.inf, 0.0, 0.25), (1, -np.inf, 1.0, 0.6)]),
        (-2.0, [(0, -np.inf, 0.0, 0.25), (1, 1.0, np.inf, 0.4)]),
        (3.0, [(0, 0.0, np.inf, 0.75), (2, -np.inf, 0.5, 0.5)]),
        (0.5, [(0, 0.0, np.inf, 0.75), (2, 0.5, np.inf, 0.5)]),
    ]
    row = np.array([0.3, 2.0, 0.2])

    def value(known):
        total = 0.0
        for v, path in leaves:
            for f, low, high, share in path:
                v *= float(low < row[f] <= high) if f in known else share
            total += v
        return total

    got = attribution.shapley(row[None, :], leaves)[0]
    for i in range(3):
        others = [j for j in range(3) if j != i]
        exact = sum(
            factorial(k) * factorial(2 - k) / 6 * (value({*s, i}) - value(set(s))) for k in range(3) for s in combinations(others, k)
        )
        assert got[i] == pytest.approx(exact)


def test_explanations(fold, model):
    tables = attribution.generate_explanations(model, model, fold[1]["test"], ["player_id"], list("abcd"))
    rows = fold[1]["test"].count()
    assert tables["contributions_a"].select("player_id").distinct().count() == rows
    assert tables["importance"].orderBy(F.desc("importance")).first()["feature"] == "a"
    top = attribution.top_contributions(tables["contributions_a"], ["player_id"], 2)
    assert top.count() == 2 * rows


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibration_keeps_order_and_range(frame, method):
    rows = [(i, float(i) / 40, int(i % 4 == 0 or i > 30)) for i in range(40)]
    df = frame(rows, "id int, s double, label int")
    fitted = learners.Calibrator.fit(df, "s", method)
    fresh = frame([(i, i / 10 - 1.0) for i in range(40)], "id int, s double")
    got = [r["c"] for r in fitted.transform(fresh, "s", "c").orderBy("id").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1


def test_platt_is_the_minimum_of_its_objective(frame):
    rng = np.random.default_rng(7)
    s = np.round(rng.random(300), 2)
    y = (rng.random(300) < s).astype(int)
    df = frame([(float(a), int(b)) for a, b in zip(s, y)], "s double, label int")
    model = learners.Calibrator.fit(df, "s", "platt").model
    w, b = model.coefficients[0], model.intercept
    p = 1 / (1 + np.exp(-(w * s + b)))
    assert abs((s * (p - y)).sum() + w) < 0.05 and abs((p - y).sum()) < 0.05


def test_isotonic_against_pooling(frame):
    df = frame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "s double, label int")
    fitted = learners.Calibrator.fit(df, "s", "isotonic")
    probe = frame([(0.0,), (0.15,), (0.2,), (0.3,), (0.35,), (0.9,)], "s double")
    got = [r["c"] for r in fitted.transform(probe, "s", "c").orderBy("s").collect()]
    assert got == pytest.approx([0, 0.25, 0.5, 0.5, 0.75, 1])


def test_search_is_repeatable(fold):
    import random

    points = [search.draw(search.SPACE_A, random.Random(1)) for _ in range(2)]
    assert points[0] == points[1] and 0.01 <= points[0]["rate"] <= 0.2 and 15 <= points[0]["max_leaves"] <= 127
    best, trials = search.random_search(fold[1]["train"], fold[1]["val"], {"max_depth": (1, 3, "int")}, 2, 3)
    assert best in [t[0] for t in trials] and all(0.5 < auc <= 1 for _, auc in trials)


@pytest.fixture(scope="module")
def shots(spark):
    rng = np.random.default_rng(1)
    n = 200
    pdf = pd.DataFrame({"player_id": [f"p{i}" for i in range(n)], "season": np.repeat(["2017-18", "2018-19", "2020-21", "2021-22"], 50), "shots_per90": rng.uniform(0, 4, n), "shots_on_target_per90": rng.uniform(0, 2, n), "position_group": rng.choice(["FW", "MF", "DF"], n), "goals_per90": 0.4})
    pdf["us_xg_per90"] = pdf.shots_per90 * 0.1 + pdf.shots_on_target_per90 * 0.05
    return spark.createDataFrame(pdf)


def test_proxy(shots):
    prepared, names = proxy.proxy_features(shots)
    assert names == ["shots_per90", "shots_on_target_per90", "pos_FW", "pos_MF", "pos_DF"]
    early, late = proxy.proxy_training_rows(prepared, names, "us_xg_per90", "season", ["player_id"])
    assert (early.count(), late.count()) == (100, 100)
    model, figures = proxy.train_proxy(early, late, "us_xg_per90", 10)
    assert figures["rank_correlation"] > 0.8 and figures["rmse"] < 0.2
    gaps = prepared.withColumn("shots_per90", F.when(F.col("player_id") != "p0", F.col("shots_per90")))
    rows = proxy.apply_proxy(gaps, model, names).where("proxy_xg_per90 is null")
    assert [r["player_id"] for r in rows.collect()] == ["p0"]
    assert proxy.apply_proxy(gaps, model, names[:2]).where("proxy_xg_per90 is not null").count() == 0


def test_proxy_falls_back(shots):
    prepared, names = proxy.proxy_features(shots)
    only_early = prepared.where("season < '2020'")
    a, b = proxy.proxy_training_rows(only_early, names, "us_xg_per90", "season", ["player_id"])
    assert a.count() + b.count() == 100 and 60 < a.count() < 95
    assert proxy.proxy_training_rows(prepared.limit(40), names, "us_xg_per90", "season", ["player_id"]) is None
    assert proxy.proxy_features(shots.select("player_id", "shots_per90"))[1] == []


def test_scoring_without_proxy_fits_nothing(frame, tmp_path):
    from tidemark.models import proxy

    rows = [(f"p{i}", "l", "2019", 1.0 + i, 2.0, 50.0, 0.1, 0.3, 0.2) for i in range(60)]
    df = frame(rows, "player_id string, league string, season string, shots_per90 double, shots_on_target_per90 double, shots_on_target_pct double, goals_per_shot_on_target double, us_xg_per90 double, goals_per90 double")
    path = str(tmp_path / "proxy")
    applied, figures = proxy.proxy_pipeline(df, path, rounds=0, train=False)
    assert figures is None and not (tmp_path / "proxy").exists()
    assert applied.where("proxy_xg_per90 IS NOT NULL").count() == 0 and applied.count() == 60
