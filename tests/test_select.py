import numpy as np
import pandas as pd
import pytest

from tidemark.operators import select


def test_impute(frame):
    rows = [("e", "FW", "s", 1.0, 10.0), ("e", "FW", "s", None, 20.0), ("e", "FW", "s", 3.0, None), ("e", "FW", "s", 4.0, 40.0)]
    df = frame(rows, "league string, position_group string, season string, feat_a double, feat_b double")
    keys = ["league", "position_group", "season"]
    got = select.impute_group_median(df, keys, ["feat_a", "feat_b"]).toPandas()
    assert sorted(got.feat_a) == [1, 3, 3, 4] and sorted(got.feat_b) == [10, 20, 20, 40]


def test_impute_groups_then_all(frame):
    rows = [("a", 1.0), ("a", None), ("b", 10.0), ("b", None), ("c", None), (None, None)]
    got = select.impute_group_median(frame(rows, "g string, v double"), ["g"], ["v"]).toPandas()
    by_group = got.groupby(got.g.fillna("-")).v.apply(list).to_dict()
    # The fallback is the median of the column after the groups are filled: 1, 1, 10, 10.
    assert by_group == {"a": [1, 1], "b": [10, 10], "c": [5.5], "-": [5.5]}


def test_medians_of_training_rows(frame):
    train = frame([(1.0, None), (2.0, None), (9.0, None)], "a double, b double")
    medians = select.fit_medians(train, ["a", "b"])
    assert medians == {"a": 2.0, "b": 0.0}
    filled = select.apply_medians(frame([(None, None)], "a double, b double"), medians).first()
    assert (filled["a"], filled["b"]) == (2.0, 0.0)


def test_pruning(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, 300)
    pdf = pd.DataFrame({"x": base, "x_big": base * 3 + rng.normal(0, 0.01, 300), "flat": 1.0, "y": rng.normal(0, 1, 300), "age": base, "league": "l", "position_group": "FW", "season": "s"})
    kept, report = select.select_features(spark.createDataFrame(pdf))
    assert report["low_variance_removed"] == ["flat"] and report["correlated_removed"] == ["x"]
    assert report["features"] == ["x_big", "y"] and "age" in kept.columns and report["input_features"] == 4


def test_greedy_choice_in_column_order():
    matrix = np.array([[1, 0.95, 0.95], [0.95, 1, 0.1], [0.95, 0.1, 1]])
    assert select.correlated(["a", "b", "c"], matrix, {"a": 1.0, "b": 2.0, "c": 3.0}, 0.9) == ["a"]
    assert select.correlated(["a", "b", "c"], matrix, {"a": 3.0, "b": 2.0, "c": 1.0}, 0.9) == ["b", "c"]


def test_correlations_against_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(5, 2, (200, 3)), columns=list("abc"))
    pdf["c"] += pdf.a
    for row in select.correlation_table(spark.createDataFrame(pdf), list("abc")).collect():
        assert row["r"] == pytest.approx(pdf[row["a"]].corr(pdf[row["b"]]), abs=1e-9)


def test_align(frame):
    df = select.align(frame([(1, 2.0, "t")], "b int, extra double, id string"), ["a", "b"], ["id"])
    assert df.columns == ["id", "a", "b"] and tuple(df.first()) == ("t", 0.0, 1.0)


def test_correlation_skips_missing_values(frame):
    rows = [(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, None, 5.0), (4.0, 8.5, 2.0)]
    found = {(r["a"], r["b"]): r["r"] for r in select.correlation_table(frame(rows, "x double, y double, z double"), ["x", "y", "z"]).collect()}
    table = pd.DataFrame(rows, columns=["x", "y", "z"]).corr()
    assert all(abs(r - table.loc[a, b]) < 1e-9 for (a, b), r in found.items()) and len(found) == 3


def test_order_of_dropped_columns():
    """Pairs are settled by their later column; an earlier column that has lost is passed over, a later one is not."""
    matrix = [[1, 0.99, 0.99], [0.99, 1, 0.99], [0.99, 0.99, 1]]
    assert select.correlated(["a", "b", "c"], matrix, {"a": 1, "b": 2, "c": 3}, 0.9) == ["a", "b"]
    assert select.correlated(["a", "b", "c"], matrix, {"a": 3, "b": 2, "c": 1}, 0.9) == ["b", "c"]
    assert select.correlated(["a", "b"], [[1, -0.99], [-0.99, 1]], {"a": 1, "b": 1}, 0.9) == ["a"]
