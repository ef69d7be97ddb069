import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import clean
from tidemark.sources import config

PEOPLE = [("A", "FW", 22, 900), ("B", "MF", 19, 500), ("C", "GK", 25, 2000), ("D", "DF", 28, 1500), ("E", "FW", 16, 300)]
SCHEMA = "name string, position_group string, age int, minutes int"


@pytest.mark.parametrize(
    "options, kept",
    [({}, "AB"), ({"min_exposure": 600}, "A"), ({"min_age": 18, "max_age": 30}, "ABD")],
)
def test_filters(frame, options, kept):
    rows = clean.keep_eligible(frame(PEOPLE, SCHEMA), **options).collect()
    assert sorted(r["name"] for r in rows) == list(kept)


@pytest.mark.parametrize(
    "text, group", [("FW", "FW"), ("FW,MF", "FW"), (" DF , MF", "DF"), (None, None), ("", None), ("XX", None)]
)
def test_listed_positions(frame, text, group):
    df = clean.with_position_group(frame([(text,)], "position string"))
    assert df.first()["position_group"] == group


@pytest.mark.parametrize("text, group", [("Left Winger", "FW"), ("Centre-Back", "DF"), ("Goalkeeper", "GK"), ("Coach", None)])
def test_market_positions(frame, text, group):
    assert clean.with_position_group(frame([(text,)], "position string"), source="market").first()["position_group"] == group


@pytest.mark.parametrize("text, group", [("F", "FW"), ("M S", "MF"), ("S", "FW"), ("Sweeper", "Sweeper"), (None, None)])
def test_short_codes_keep_unknown_text(frame, text, group):
    df = frame([(text,)], "position string").select(scalar.short_code(F.col("position"), config.SHORT_CODES).alias("g"))
    assert df.first()["g"] == group


def test_cap_by_group(frame):
    rows = [("FW", 0.5, 20, 3)] * 49 + [("FW", 100.0, 99, 3)] + [("DF", 0.1, 5, 3)] * 49 + [("DF", 50.0, 80, 3)]
    df = frame(rows, "position_group string, xg double, age int, shots int")
    capped = clean.cap_outliers(df, "position_group", ["xg", "shots"], count_name="capped")
    top = {r["position_group"]: r["m"] for r in capped.groupBy("position_group").agg(F.max("xg").alias("m")).collect()}
    assert top["FW"] == pytest.approx(51.245) and top["DF"] == pytest.approx(25.549)
    assert capped.agg(F.sum("capped")).first()[0] == 2 and capped.count() == 100


def test_integer_caps_are_truncated_and_gaps_stay(frame):
    rows = [("FW", i, None if i == 5 else 0.1) for i in range(1, 51)]
    capped = clean.cap_outliers(frame(rows, "g string, n int, xg double"), "g", ["n", "xg"])
    assert capped.agg(F.max("n")).first()[0] == int(np.percentile(range(1, 51), 99)) == 49
    assert dict(capped.dtypes)["n"] == "int" and capped.where("xg is null").count() == 1


def test_clean_chain(frame):
    rows = [("A", "FW,MF", 22, 900, 5), ("B", "GK", 22, 900, 5), ("C", "??", 22, 900, 5), ("D", "DF", 40, 900, 5)]
    df = frame(rows, "name string, position string, age int, minutes int, goals int")
    assert [r["name"] for r in clean.clean(df).collect()] == ["A"]
    report = clean.cleaning_report(df).first().asDict()
    assert report == {
        "total_raw": 4, "after_position_norm": 3, "gk_removed": 1, "after_age_filter": 1, "after_minutes_filter": 1,
    }
