import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, unify
from tidemark.sources import config, tables
from tidemark.streaming.ingest import stream_upserts

FIRST = ("p1", "Ulo Vandremer", "Northwold Rovers", "eredivisie", "2022-2023", 21)
OTHER = ("p2", "Test Player", "Ajax", "eredivisie", "2022-2023", 5)
SCHEMA = "player_id string, name string, team string, league string, season string, goals int"


def test_load_fills_defaults_and_drops_unknown_columns(frame):
    records = frame([(*FIRST, "x")], SCHEMA + ", unknown string")
    loaded = tables.load_records(records, "counts")
    row = loaded.first()
    assert len(loaded.columns) == 96 and row["source"] == "counts" and row["scraped_at"] is not None and row["xg"] is None
    assert [len(tables.SCHEMAS[s]) for s in ("market", "expected")] == [12, 30]


def test_load_refuses_a_missing_key(frame):
    with pytest.raises(Exception, match="player_id must not be NULL"):
        tables.load_records(frame([(None, *FIRST[1:])], SCHEMA), "counts").collect()


def test_upsert_table(spark, frame, tmp_path):
    path = str(tmp_path / "counts")
    assert tables.write_upsert(tables.load_records(frame([FIRST, OTHER], SCHEMA), "counts"), path) == 2
    assert tables.write_upsert(tables.load_records(frame([FIRST], SCHEMA).limit(0), "counts"), path) == 0
    tables.write_upsert(tables.load_records(frame([(*FIRST[:5], 25)], SCHEMA), "counts"), path)
    tables.write_upsert(tables.load_records(frame([("p3", "N", "T", "serie-b", "2020-2021", 1)], SCHEMA), "counts"), path)
    goals = {r["player_id"]: r["goals"] for r in tables.scan(spark, path).collect()}
    assert goals == {"p1": 25, "p2": 5, "p3": 1}
    scan = tables.scan(spark, path, {"league": "eredivisie", "season": None})
    assert scan.count() == 2 and "PartitionFilters: [isnotnull(league" in scan._jdf.queryExecution().executedPlan().toString()


def test_upsert_keeps_columns_of_either_side(spark, frame, tmp_path):
    path = str(tmp_path / "table")
    key = ["player_id"]
    tables.write_upsert(frame([("a", 1, 10, "x"), ("b", 2, 20, "x"), ("c", 3, 30, None)], "player_id string, v int, y int, part string"), path, key, ["part"])
    tables.write_upsert(frame([("a", 5, "x", 1.5), ("d", 6, None, 2.5)], "player_id string, v int, part string, z double"), path, key, ["part"])
    rows = {r["player_id"]: (r["v"], r["y"], r["z"]) for r in spark.read.option("mergeSchema", True).parquet(path).collect()}
    assert rows == {"a": (5, None, 1.5), "b": (2, 20, None), "c": (3, 30, None), "d": (6, None, 2.5)}


def test_late_record_does_not_replace_a_newer_one(spark, frame, tmp_path):
    path = str(tmp_path / "table")
    schema = "player_id string, part string, at int, v int"
    for at, v in ((5, 1), (3, 2), (5, 3), (None, 4)):
        tables.write_upsert(frame([("a", "x", at, v)], schema), path, ["player_id"], ["part"], newest="at")
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [3]


def test_scan_reads_nan_as_null(spark, frame, tmp_path):
    path = str(tmp_path / "nan")
    frame([(1, float("nan")), (2, 2.0)], "i int, x double").write.parquet(path)
    assert {r["i"]: r["x"] for r in tables.scan(spark, path).collect()} == {1: None, 2: 2.0}


def test_stream_of_records(spark, frame, tmp_path):
    source, path = str(tmp_path / "incoming"), str(tmp_path / "table")
    frame([FIRST, OTHER], SCHEMA).coalesce(1).write.json(source)
    for goals in (None, 30):
        if goals:
            frame([(*FIRST[:5], goals)], SCHEMA).coalesce(1).write.mode("append").json(source)
        records = spark.readStream.schema(SCHEMA).json(source)
        stream_upserts(records, "counts", path, str(tmp_path / "check")).awaitTermination(120)
    assert {r["player_id"]: r["goals"] for r in spark.read.parquet(path).collect()} == {"p1": 30, "p2": 5}


def test_sql_parameters(spark, frame):
    df = frame([FIRST, OTHER], SCHEMA)
    assert tables.sql(spark, "SELECT name FROM {players} WHERE goals > :g", {"g": 10}, players=df).first()[0] == "Ulo Vandremer"


def test_unified_players(frame):
    keys = {"team": "Northwold Rovers", "league": "eredivisie", "season": "2022-2023"}

    def source(name, **columns):
        df = frame([("id",)], "player_id string").withColumns({k: F.lit(v) for k, v in {**keys, "name": name, **columns}.items()})
        return df

    a = tables.conform(source("Ulo Vandremer", passes_completed=1200, xg=1.0, age=23), tables.COUNTS_SCHEMA)
    b = tables.conform(source("ULO VANDREMER", market_value_eur=45000000, age=24), tables.MARKET_SCHEMA)
    c = tables.conform(source("ulo vandremer", xg_chain=22.5, xg=15.8), tables.EXPECTED_SCHEMA)
    lonely = tables.conform(source("Nobody", team=None), tables.EXPECTED_SCHEMA)
    rows = unify.unified_players(a, b, c.unionByName(lonely)).collect()
    assert len(rows) == 2
    row = next(r for r in rows if r["name"] == "Ulo Vandremer")
    assert (row["market_value_eur"], row["xg_chain"], row["passes_completed"], row["xg"], row["age"]) == (45000000, 22.5, 1200, 15.8, 24)
    assert len(row) == 34


def test_null_keys_never_join(frame):
    left, right = frame([(1, None), (2, "x")], "l int, k string"), frame([(3, None), (4, "x")], "r int, j string")
    got = unify.full_outer(left, right, [(F.col("k"), F.col("j"))]).collect()
    assert {(r["l"], r["r"]) for r in got} == {(1, None), (2, 4), (None, 3)}


def test_later_tables_overwrite_also_with_null(frame):
    base = frame([(1, "a", 5), (2, "b", 6)], "id int, name string, shared int")
    other = frame([(1, None, 9)], "id int, shared int, fresh int")
    got = {r["id"]: (r["shared"], r["fresh"]) for r in unify.merge_overwrite(base, [other], "id").collect()}
    assert got == {1: (None, 9), 2: (6, None)}


def test_source_stats(frame):
    a, b = frame([("l1", "s1"), ("l2", "s1")], "league string, season string"), frame([("l1", "s2")], "league string, season string")
    row = quality.source_stats({"a": a, "b": b, "none": a.limit(0)}, "league", "season").first()
    assert tuple(row) == (2, 1, 0, 2, 2)
    assert sorted(r[0] for r in quality.distinct_union([a, b], "season").collect()) == ["s1", "s2"]


def test_round_trips(spark, frame, tmp_path):
    df = frame([FIRST, OTHER], SCHEMA)
    expected = {tuple(r) for r in df.collect()}
    tables.write_table(df, f"{tmp_path}/p", ["league"])
    tables.write_csv(df, f"{tmp_path}/c")
    tables.write_json(df, f"{tmp_path}/j")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/p").select(df.columns).collect()} == expected
    assert {tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/c", SCHEMA).collect()} == expected
    assert {tuple(r) for r in tables.read_json(spark, f"{tmp_path}/j", SCHEMA).collect()} == expected
    tables.write_report(spark, {"kept": ["a"], "n": 1}, f"{tmp_path}/r")
    assert tables.read_report(spark, f"{tmp_path}/r") == {"kept": ["a"], "n": 1}


def test_nan_is_missing(frame):
    row = tables.without_nan(frame([(float("nan"), 1.0)], "a double, b double")).first()
    assert tuple(row) == (None, 1.0)


def test_kept_tables_can_be_discarded(spark, frame):
    from tidemark import shared

    kept = shared.keep(frame([(1,)], "n int"))
    assert kept.count() == 1 and shared.discard_kept(spark) and not shared.discard_kept(spark)


def test_league_table(spark):
    rows = {r["slug"]: r for r in config.league_table(spark).collect()}
    assert len(rows) == 13 and rows["serie-b"]["priority"] == 2 and rows["la-liga"]["coefficient"] == 0.95
    assert config.league_coefficients()["belgian-pro-league"] == config.league_coefficients()["Belgian Pro League"] == 0.75
