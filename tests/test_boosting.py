import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.models import attribution, boosting
from tidemark.models.boosting import UNIT, Boosted, Shape
from tidemark.sources import config

RNG = np.random.default_rng(5)
N = 500
X = np.round(RNG.normal(size=(N, 3)), 2)
Y = (X[:, 0] - X[:, 1] * X[:, 2] + RNG.normal(0, 0.7, N) > 0.6).astype(int)
W = np.where(Y == 1, 2.5, 1.0)


@pytest.fixture(scope="module")
def sides(spark):
    pdf = pd.DataFrame(X, columns=list("abc")).assign(label=Y, weight=W, id=np.arange(N))
    rows = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(pdf))
    return rows.where("id < 350"), rows.where("id >= 350")


def plain_tree(x, y, w, margin, shape):
    """One tree by trying every value of every feature, the leaf of greatest gain first."""
    p = 1 / (1 + np.exp(-margin))
    g, h = np.rint((p - y) * w * UNIT) / UNIT, np.rint(p * (1 - p) * w * UNIT) / UNIT

    def part(at):
        total, weight = g[at].sum(), h[at].sum() + shape.l2
        return max(abs(total) - shape.l1, 0.0) ** 2 / weight

    def best(at):
        found = (0.0, None, None)
        for f in range(x.shape[1]):
            for cut in np.unique(x[at, f])[:-1]:
                left = at & (x[:, f] <= cut)
                right = at & ~left
                if min(left.sum(), right.sum()) < shape.min_rows:
                    continue
                if min(h[left].sum(), h[right].sum()) < shape.min_hessian:
                    continue
                gain = part(left) + part(right) - part(at)
                if gain > found[0] + 1e-9:
                    found = (gain, left, right)
        return found

    leaves = [(np.ones(len(x), bool), 0)]
    while True:
        open_leaves = [
            (best(at), i) for i, (at, depth) in enumerate(leaves) if not shape.max_depth or depth < shape.max_depth
        ]
        gain, i = max(((b[0], i) for b, i in open_leaves), default=(0.0, 0))
        if gain <= 0 or (shape.max_leaves and len(leaves) >= shape.max_leaves):
            break
        _, left, right = next(b for b, j in open_leaves if j == i)
        depth = leaves.pop(i)[1] + 1
        leaves += [(left, depth), (right, depth)]
    step = np.zeros(len(x))
    for at, _ in leaves:
        total = g[at].sum()
        shrunk = np.sign(total) * max(abs(total) - shape.l1, 0.0)
        step[at] = -shape.rate * shrunk / (h[at].sum() + shape.l2)
    return step


@pytest.mark.parametrize(
    "shape",
    [
        Shape(max_leaves=7, rate=0.3, min_rows=10),
        Shape(max_leaves=0, max_depth=3, rate=0.3, l1=0.5, l2=1.0, min_hessian=1.0),
        Shape(max_leaves=6, max_depth=4, rate=0.3, l2=0.5, min_rows=5),
    ],
)
def test_equal_to_a_plain_version(sides, shape):
    train, validation = sides
    model = boosting.boost(train, validation, shape, 3, 50)
    while len(model.trees) < 3:  # the best round may come early; the plain version needs all of them
        model = boosting.boost(train, train, shape, 3, 50)
    x, y, w = X[:350], Y[:350], W[:350]
    cuts = boosting.edges(train, 3)
    for i, c in enumerate(cuts):  # fewer than 256 distinct values, or quantiles of them
        assert set(c) <= set(x[:, i]) and len(c) <= 255
    binned = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1).astype(float)
    share = (w * y).sum() / w.sum()
    margin = np.full(350, np.log(share / (1 - share)))
    for _ in range(3):
        margin = margin + plain_tree(binned, y, w, margin, shape)
    np.testing.assert_allclose(model.margins(x), margin, atol=1e-6)


def test_going_on_equals_one_run(sides, monkeypatch):
    train, _ = sides
    shape = Shape(max_leaves=5, rate=0.2, row_share=0.7, row_every=2, feature_share=0.7)
    monkeypatch.setattr(boosting, "BLOCK", 2)  # margins are written in between
    whole = boosting.boost(train, train, shape, 6, 50)
    monkeypatch.setattr(boosting, "BLOCK", 3)
    first = boosting.boost(train, train, shape, 3, 50)
    more = boosting.boost(train, train, shape, 3, 50, model=first)
    assert len(first.trees) == 3 and len(more.trees) == len(whole.trees) == 6
    np.testing.assert_allclose(more.margins(X), whole.margins(X), atol=1e-9)


def test_patience_watches_the_auc(sides):
    train, validation = sides
    flipped = validation.withColumn("label", 1 - F.col("label"))
    model = boosting.boost(train, flipped, Shape(max_leaves=4), 60, 3)
    assert len(model.trees) < 10 and len(model.scores) == len(model.trees)
    assert boosting.best_round([0.5, 0.6, 0.55, 0.58, 0.7], 2) == (2, True)
    assert boosting.best_round([0.5, 0.6, 0.55, 0.58, 0.7], 3) == (5, False)


def test_scores_are_the_auc_of_the_margin(sides):
    train, validation = sides
    model = boosting.boost(train, validation, Shape(max_leaves=4, rate=0.3), 4, 50)
    margin = model.margins(X[350:])
    y = Y[350:]
    higher = (margin[y == 1][:, None] > margin[y == 0]).mean() + (margin[y == 1][:, None] == margin[y == 0]).mean() / 2
    assert model.scores[-1] == pytest.approx(higher) == max(model.scores)


def test_saved_model(spark, sides, tmp_path):
    model = boosting.boost(sides[0], sides[0], Shape(max_leaves=5), 3, 50)
    model.save(spark, str(tmp_path / "m"))
    again = Boosted.load(spark, str(tmp_path / "m"))
    np.testing.assert_array_equal(again.margins(X), model.margins(X))
    assert again.scores == model.scores
    rows = {r["id"]: r["p"] for r in model.with_probability(sides[1], "p").collect()}
    expected = 1 / (1 + np.exp(-model.margins(X)))
    assert all(p == pytest.approx(expected[i]) for i, p in rows.items())


def test_values_without_order(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, np.nan, np.nan, np.nan] * 20, "weight": 1.0})
    pdf["label"] = pdf.a.isna().astype(int)
    rows = VectorAssembler(inputCols=["a"], outputCol="features", handleInvalid="keep").transform(spark.createDataFrame(pdf))
    model = boosting.boost(rows, rows, Shape(max_leaves=2, rate=1.0), 1, 50)
    low, high = model.margins(np.array([[1.0], [np.nan]]))
    assert low < 0 < high
    parts = attribution.explain(model, rows.withColumn("id", F.monotonically_increasing_id()), ["id"], ["a"])
    total = {r["m"] for r in parts.select((F.round(F.col("base_value") + F.col("contribution"), 9)).alias("m")).collect()}
    assert total == {round(low, 9), round(high, 9)}


def test_bags_are_repeatable_and_even():
    rows = np.arange(20000)
    first, again, other = boosting.drawn(rows, 1, 0.8), boosting.drawn(rows, 1, 0.8), boosting.drawn(rows, 2, 0.8)
    assert (first == again).all() and abs(first.mean() - 0.8) < 0.02 and 0.62 < (first & other).mean() < 0.66


def test_frontiers_larger_than_the_bound(sides, monkeypatch):
    shape = Shape(max_leaves=0, max_depth=4)
    whole = boosting.boost(sides[0], sides[0], shape, 1, 50)
    monkeypatch.setattr(boosting, "SUM_BYTES", 24 * 256 * 3 * 2)  # two nodes a pass
    parts = boosting.boost(sides[0], sides[0], shape, 1, 50)
    np.testing.assert_array_equal(whole.margins(X), parts.margins(X))


def test_refuses_no_rows_and_no_limit(sides):
    with pytest.raises(ValueError):
        boosting.boost(sides[0].where("false"), sides[1], Shape(), 1, 1)
    with pytest.raises(ValueError):
        boosting.boost(*sides, Shape(max_leaves=0), 1, 1)
    assert random.Random(f"{config.SEED} 0").random() == random.Random("42 0").random()
