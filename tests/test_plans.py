"""The whole chain on a small made-up league system."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans.process import process
from tidemark.plans.report import validation_report
from tidemark.plans.score import load_trained, prepare, score
from tidemark.plans.train import saved_shapes, train
from tidemark.sources import tables

META = ["player_id", "name", "league", "season"]


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(8)
    counts, market, expected = [], [], []
    leagues = {"eredivisie": 0.85, "championship": 0.78, "premier-league": 1.0, "la-liga": 0.95}
    for i in range(90):
        skill = rng.random()
        born = rng.randint(1996, 2000)
        position = rng.choice(["FW", "MF,DF", "DF", "GK"] if i % 9 == 0 else ["FW", "MF,DF", "DF"])
        league = rng.choice(["eredivisie", "championship"])
        for year in range(2015, 2024):
            if year - born < 17 or rng.random() < 0.1:
                continue
            if skill > 0.5 and year - born > 21:
                league = rng.choice(["premier-league", "la-liga"])
            season = f"{year}-{year + 1}"
            minutes = rng.randint(500, 3000)
            goals = int(minutes / 90 * (0.1 + 0.5 * skill) * rng.uniform(0.5, 1.5))
            name = f"{'abcdefghij'[i % 10]}{'lmnopqrstu'[i // 10]} {'vwxyz'[i % 5]}{i % 7}son"
            common = {"player_id": f"a{i}", "name": name, "team": f"Team {i % 4}", "league": league, "season": season}
            counts.append({
                **common, "position": position, "age": year - born, "birth_year": born, "games": 30, "games_starts": rng.randint(0, 30),
                "minutes": minutes, "minutes_90s": minutes / 90, "goals": goals, "assists": rng.randint(0, 9), "shots": goals * 4 + 3,
                "shots_on_target": goals * 2 + 1, "tackles": rng.randint(5, 60), "interceptions": rng.randint(5, 60), "pens_made": 0,
                "progressive_carries": rng.randint(5, 90),
            })
            market.append({**common, "player_id": f"m{i}", "market_value_eur": int(1e6 * (1 + 20 * skill))})
            if league in ("premier-league", "la-liga"):
                expected.append({**common, "player_id": f"u{i}", "xg": goals * 0.9, "xa": 1.0, "npxg": goals * 0.8, "xg_per90": goals * 0.9 / minutes * 90, "xa_per90": 0.1, "npxg_per90": 0.2, "xg_chain": 3.0, "xg_buildup": 1.0, "shots": 5, "key_passes": 4, "xg_overperformance": 0.1, "xa_overperformance": 0.0})

    def table(rows, source):
        names = list(rows[0])
        schema = tables.SCHEMAS[source]
        types = ", ".join(f"{n} {schema[n].dataType.simpleString()}" for n in names)
        return tables.load_records(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], types), source).drop("scraped_at")

    return table(counts, "counts"), table(market, "market"), table(expected, "expected")


@pytest.fixture(scope="module")
def processed(sources, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("process"))
    return process(*sources, out, proxy_rounds=3), out


def test_process(processed, sources):
    result, out = processed
    enriched = result["enriched"]
    assert enriched.where("position_group = 'GK' OR age > 26 OR minutes < 450").count() == 0
    assert enriched.where("market_value_eur IS NULL").count() == 0  # every row has its own market row
    assert enriched.where("match_confidence_us IS NOT NULL AND league NOT IN ('premier-league', 'la-liga')").count() == 0
    labelled = result["labeled"]
    assert {r[0] for r in labelled.select("league").distinct().collect()} == {"eredivisie", "championship"}
    assert {r[0] for r in labelled.select("label").distinct().collect()} == {0, 1}
    final = result["features"]
    assert final.count() == labelled.where("minutes_90s >= 0.5").count()
    report = tables.read_report(final.sparkSession, f"{out}/selection_report")
    assert report["final_features"] == len(report["features"]) < report["input_features"]
    assert final.where(" OR ".join(f"`{c}` IS NULL" for c in report["features"])).count() == 0
    assert {(r["fold"], r["split"]) for r in result["folds"].select("fold", "split").distinct().collect()} == {(f, s) for f in (1, 2, 3) for s in ("train", "val", "test")}
    assert [r["warnings"] for r in result["leakage"].collect()] == [""] * 3


def test_proxy_runs_before_the_interactions(sources, tmp_path):
    counts, market, expected = sources
    rows = prepare(counts, market, expected, None, ["2019-2020"], ["premier-league"])
    assert "proxy_xg_x_age" in rows.columns and rows.where("season <> '2019-2020'").count() == 0


def test_train_score_report(processed, sources, tmp_path):
    result, _ = processed
    out = str(tmp_path / "models")
    trained = train(result["folds"], META, out=out, numbers=[2, 3], trials=1, rounds=3)
    predictions = trained["predictions"]
    tests = result["folds"].where("split = 'test' AND fold IN (2, 3)").count()
    assert predictions.count() == tests
    assert predictions.where("prob_calibrated BETWEEN 0 AND 1").count() == tests
    assert trained["metrics"].count() == 2 * 4 * 11 and trained["summary"].count() == 44
    spark = predictions.sparkSession
    schema = "player_id string, name string, league string, season string, label int, prob_a double, prob_b double, prob_ensemble double, prob_calibrated double, fold int"
    stored = tables.read_csv(spark, f"{out}/predictions", schema)
    assert stored.count() == tests and stored.where("prob_calibrated IS NULL").count() == 0
    assert spark.read.parquet(f"{out}/fold_3/contributions_a").select(*META).distinct().count() == predictions.where("fold = 3").count()

    tried = spark.read.parquet(f"{out}/trials").orderBy("model").collect()
    assert [(r["model"], r["trial"], r["chosen"]) for r in tried] == [("a", 0, True), ("b", 0, True)]
    assert saved_shapes(spark, out) == trained["shapes"] == {r["model"]: json.loads(r["parameters"]) for r in tried}

    fresh = result["labeled"].where("season = '2020-2021'").drop("tackles", "label")
    scored, parts = score(fresh, **load_trained(spark, out, 3), meta=META, out=str(tmp_path / "scored"))
    order = [r["prob_calibrated"] for r in scored.collect()]
    assert order == sorted(order, reverse=True) and len(order) == fresh.count()
    assert parts.count() == fresh.count() * len(trained["inputs"].features)

    labelled = result["labeled"]
    full = predictions.join(labelled.select("player_id", "league", "season", "position", "birth_year", "breakout_league"), on=["player_id", "league", "season"])
    tables_of = validation_report(full, result["features"], sources[0], trained["importance"], trained["summary"], "player_id")
    assert tables_of["top"].count() == min(20, tests) and "age" in tables_of["top"].columns
    assert tables_of["verdict"].count() == 1 and tables_of["thresholds"].count() == 9
    assert tables_of["per_fold"].agg(F.sum("n")).first()[0] == tests
    assert tables_of["false_positives"].where("near_miss NOT IN (0, 1)").count() == 0
    assert tables_of["missed"].where("reason IS NULL").count() == 0


def test_train_with_given_shapes(processed):
    result, _ = processed
    shape = {"max_depth": 2, "rate": 0.1}
    trained = train(result["folds"], META, numbers=[3], trials=4, rounds=2, shapes={"a": shape, "b": {**shape, "max_depth": 1}})
    assert trained["trials"].count() == 0 and trained["shapes"]["a"] == shape
    assert trained["model_a"].trees[0].depth <= 2 and trained["model_b"].trees[0].depth <= 1
