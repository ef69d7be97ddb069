import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import explore
from tidemark.plans.report import season_reasons


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(3, 2, (120, 3)), columns=list("xyz")).assign(flat=1.0, id=range(120), label=[i % 2 for i in range(120)])
    pdf.loc[5, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).repartition(5)
    values = pdf[["x", "y", "z", "flat"]]
    spread = values.std(ddof=0).replace(0, 1)
    return explore.standardized(df, ["x", "y", "z", "flat"]), ((values - values.mean()) / spread).fillna(0).to_numpy()


def brute(matrix, query, n, allowed):
    distance = np.sqrt(((matrix - matrix[query]) ** 2).sum(1))
    return sorted((round(distance[i], 9), i) for i in allowed if i != query)[:n]


@pytest.mark.parametrize("per_pass", [1000, 7])
def test_neighbours(vectors, monkeypatch, per_pass):
    """Few queries in one pass, and many queries in a grid, find the same exact neighbours."""
    monkeypatch.setattr(explore, "QUERIES_PER_PASS", per_pass)
    monkeypatch.setattr(explore, "ROWS_PER_SLICE", 25)
    rows, matrix = vectors
    queries = rows.where("id % 6 = 0")
    got = explore.nearest_neighbours(rows, queries, "id", 5, only=F.col("label") == 1).orderBy("query_id", "rank").collect()
    expected = [(q, i, d) for q in range(0, 120, 6) for d, i in brute(matrix, q, 5, range(1, 120, 2))]
    assert [(r["query_id"], r["id"]) for r in got] == [(q, i) for q, i, _ in expected]
    assert [r["distance"] for r in got] == pytest.approx([d for *_, d in expected])


def test_percentiles(frame):
    rows = [(1, "g", 1.0, None), (2, "g", 2.0, None), (3, "g", 2.0, None), (4, "g", None, None), (5, "h", 9.0, 1.0)]
    df = frame(rows, "id int, g string, v double, w double")
    got = {(r["id"], r["feature"]): r["percentile"] for r in explore.peer_percentiles(df, "id", "g", ["v", "w"]).collect()}
    assert got[(1, "v")] == pytest.approx(100 / 3) and got[(2, "v")] == got[(3, "v")] == 100 and got[(4, "v")] == 50
    assert got[(1, "w")] == 50 and got[(5, "w")] == 100 and len(got) == 10
    radar = explore.radar_profile(explore.peer_percentiles(df, "id", "g", ["v", "w"]), "id", "g", {"g": ["v"]})
    assert radar.count() == 4 and radar.first()["group_average"] == 50


def test_first_feature_row_and_reasons(frame):
    missed = frame([("a", "s", "FW"), ("b", "s", "DF"), ("c", "s", "FW")], "player_id string, season string, position string")
    rows = frame([("a", "s", 29, 800, 0.01, 2), ("a", "s", 20, 2000, 0.5, 3), ("b", "s", 20, 2000, 0.0, 1)], "player_id string, season string, age int, minutes int, goals_per90 double, n int")
    found = explore.look_up(missed, rows, ["player_id", "season"], [F.col("n").asc()])
    found = found.withColumn("r", season_reasons(found.columns))
    assert {r["player_id"]: r["r"] for r in found.collect()} == {
        "a": "older (age >= 27); low minutes (800); low goal rate", "b": "model uncertainty", "c": "model uncertainty",
    }


def test_seen_in_target(frame):
    df, history = frame([("a",), ("b",)], "p string"), frame([("a", "top", 1), ("a", "top", 2), ("b", "low", 3)], "p string, l string, n int")
    got = explore.seen_in_target(df, history, "p", F.col("l") == "top", "hit").collect()
    assert {r["p"]: r["hit"] for r in got} == {"a": 1, "b": 0}
