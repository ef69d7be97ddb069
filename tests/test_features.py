import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.sources import config


def one(df, **where):
    for column, value in where.items():
        df = df.where(F.col(column) == value)
    return df.first()


def test_rates(frame):
    rows = [("a", 10.0, 5, 3), ("b", 20.0, 10, 4), ("c", 0.3, 1, 0)]
    df = features.add_rates(frame(rows, "id string, minutes_90s double, goals int, assists int"))
    assert df.count() == 2 and one(df, id="a")["goals_per90"] == 0.5 and one(df, id="b")["assists_per90"] == 0.2
    assert "xg_per90" not in df.columns


def test_derived_and_peers(frame):
    rows = [("p1", 0.5, 0.2, 2.0, 1.0, "FW"), ("p2", 0.3, 0.1, 3.0, 1.0, "FW"), ("p3", 0.2, 0.3, 1.0, 0.5, "MF"), ("p4", 0.4, 0.1, 1.5, 0.5, "MF")]
    df = frame(rows, "player_id string, goals_per90 double, assists_per90 double, shots_per90 double, shots_on_target_per90 double, position_group string")
    df = df.withColumns({"league": F.lit("Eredivisie"), "season": F.lit("2020-21"), "age": F.lit(22), "games": F.lit(0), "games_starts": F.lit(0)})
    row = one(features.add_derived(df), player_id="p1")
    assert row["goals_above_avg"] == pytest.approx(0.1)
    assert row["naive_xg_per90"] == pytest.approx(2.0 * 0.4 / (2.5 + 1e-6)) and row["finishing_skill"] == pytest.approx(0.5 - row["naive_xg_per90"])
    assert row["age_potential_factor"] == 0.5 and row["start_ratio"] is None
    assert row["goal_contribution_league_adj"] == pytest.approx(0.7 * 0.85)
    assert row["is_forward"] == 1 and row["mf_assists_above_avg"] == 0 and row["fw_goals_above_avg"] == pytest.approx(0.1)


def test_missing_peer_key_has_no_peers(frame):
    df = frame([("a", None, 1.0), ("b", None, 3.0), ("c", "x", 5.0)], "id string, g string, v double")
    found = {r["id"]: r["d"] for r in features.add_peer_deviation(df, ["g"], {"d": "v"}).collect()}
    assert found == {"a": None, "b": None, "c": 0.0}


def test_growth(frame):
    rows = [("p1", "2019-20", "l", 0.3), ("p1", "2020-21", "l", 0.5), ("p2", "2020-21", "l", 0.4)]
    df = frame(rows, "player_id string, season string, league string, xg_per90 double")
    grown = features.add_history(df, "player_id", "season", ["league"], growth={"xg_per90_growth": "xg_per90"})
    assert one(grown, player_id="p1", season="2020-21")["xg_per90_growth"] == pytest.approx(0.6452, abs=1e-4)
    assert grown.where("xg_per90_growth is null").count() == 2


def test_history(frame):
    rows = [("p1", 2018, 0.2, 1000), ("p1", 2019, 0.4, 1500), ("p1", 2021, 0.6, 2000), ("p2", 2020, 0.9, 500)]
    df = frame(rows, "player_id string, season int, goals_per90 double, minutes int")
    spec = {k: v for k, v in config.HISTORY.items() if "assists" not in k}
    rows = features.add_history(df, "player_id", "season", ["minutes"], history=spec, count_name="career_seasons").orderBy("season").collect()
    first, second, lone, last = rows
    assert [r["career_seasons"] for r in rows] == [1, 2, 1, 3]
    assert (first["career_avg_goals_per90"], first["goals_trend"]) == (0.2, None)
    assert second["career_avg_goals_per90"] == pytest.approx(0.3) and last["career_max_goals_per90"] == 0.6
    assert last["goals_trend"] == pytest.approx(0.2) and last["minutes_trend"] == pytest.approx(500)
    assert lone["career_avg_minutes"] is None and lone["minutes_trend"] is None
    strict = features.add_history(df, "player_id", "season", ["minutes"], history=spec, strict=True).orderBy("season").first()
    assert strict["career_avg_goals_per90"] is None


def test_history_of_a_hot_entity_against_pandas(spark):
    """One entity holds most rows, with several rows a period and gaps in the measure."""
    rng = np.random.default_rng(2)
    n = 1200
    pdf = pd.DataFrame({"e": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)), "p": rng.integers(2000, 2012, n), "t": np.arange(n), "v": rng.normal(10, 3, n)})
    pdf["w"] = pdf.v.where(rng.random(n) > 0.02)
    pdf = pdf.sort_values(["e", "p", "t"]).reset_index(drop=True)
    df = spark.createDataFrame(pdf).withColumn("w", F.nanvl("w", F.lit(None).cast("double"))).repartition(7)
    spec = {"mean": ("mean", "w"), "max": ("max", "w"), "slope": ("slope", "v"), "slope_w": ("slope", "w")}
    got = features.add_history(df, "e", "p", ["t"], {"g": "w"}, spec, "n").toPandas().sort_values(["e", "p", "t"]).reset_index(drop=True)
    groups = pdf.groupby("e")
    assert (got.n == groups.cumcount() + 1).all()
    before = groups.w.shift()
    np.testing.assert_allclose(got.g.astype(float), (pdf.w - before) / (before.abs() + 0.01))
    np.testing.assert_allclose(got["mean"].astype(float), groups.w.expanding().mean().to_numpy())
    np.testing.assert_allclose(got["max"].astype(float), groups.w.expanding().max().to_numpy())
    for e, part in pdf.groupby("e"):
        mine = got[got.e == e]
        for i in (1, 2, len(part) // 2, len(part) - 1):
            y = part.v.to_numpy()[: i + 1]
            assert mine.slope.iloc[i] == pytest.approx(np.polyfit(np.arange(i + 1.0), y, 1)[0], abs=1e-8)
            expected_null = part.w.iloc[: i + 1].isna().any()
            assert pd.isna(mine.slope_w.iloc[i]) == expected_null


def test_interactions_only_where_inputs_exist(frame):
    df = frame([(0.5, 2.0)], "age_potential_factor double, minutes_played_growth double")
    found = features.add_where_present(df, features.interaction_formulas())
    assert found.columns[2:] == ["age_x_minutes_growth"] and found.first()[2] == 1.0


def test_unknown_league_counts_as_one(frame):
    df = features.add_coefficient(frame([("eredivisie", 1.0), ("Serie B", 1.0), ("moon league", 1.0)], "league string, xg_per90 double"))
    scaled = features.scale_by_coefficient(df, ["xg_per90"], F.col("_coefficient"))
    assert [r["xg_per90_league_adj"] for r in scaled.collect()] == [0.85, 0.72, 1.0]


def test_hot_entity_equals_plain_windows(spark):
    """One entity with 60,000 rows, more than whole numbers allow to square twice, and NULL periods."""
    rows = spark.range(60_000).select(
        F.lit("e").alias("entity"), F.when(F.col("id") >= 50, F.col("id") % 100).alias("period"), F.col("id").alias("tie"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("v")
    )
    found = features.add_history(rows, "entity", "period", ["tie"], {"grown": "v"}, {"mean": ("mean", "v"), "slope": ("slope", "v")}).toPandas()
    ordered = found.sort_values(["period", "tie"], na_position="first").reset_index(drop=True)
    v, n = ordered["v"].to_numpy(), np.arange(1, 60_001)
    assert np.allclose(ordered["mean"], np.cumsum(v) / n)
    top = np.cumsum((n - 1.0) * v) - (n - 1) / 2 * np.cumsum(v)
    assert np.allclose(ordered["slope"][1:], (top[1:] / (n[1:] * (n[1:] ** 2.0 - 1) / 12)), atol=1e-9)
    assert np.allclose(ordered["grown"][1:], (v[1:] - v[:-1]) / (np.abs(v[:-1]) + 0.01))


def test_dates_and_times_as_ties(frame):
    rows = [("a", 1, i, float(i)) for i in range(6)]
    df = frame(rows, "entity string, period int, i int, v double")
    for tie in (F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")), F.timestamp_seconds(F.col("i"))):
        found = features.add_history(df.withColumn("at", tie), "entity", "period", ["at"], history={"most": ("max", "v")})
        assert [r["most"] for r in found.orderBy("i").collect()] == [float(i) for i in range(6)]
