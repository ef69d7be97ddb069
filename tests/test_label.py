import pytest
from pyspark.sql import functions as F

from tidemark.operators import label

HISTORY = [
    ("pA", "eredivisie", "2018-19", 2000), ("pA", "eredivisie", "2019-20", 2500), ("pA", "premier-league", "2021-22", 1500),
    ("pB", "eredivisie", "2018-19", 1800), ("pB", "eredivisie", "2019-20", 1900), ("pB", "eredivisie", "2020-21", 2000),
    ("pB", "eredivisie", "2022-23", 2100), ("pC", "eredivisie", "2019-20", 1200), ("pC", "premier-league", "2021-22", 500),
    ("pD", "eredivisie", "2021-22", 1000), ("pE", "premier-league", "2020-21", 2700),
    ("pE", "premier-league", "2021-22", 2800), ("pF", "premier-league", "2022-23", 1000),
]


@pytest.fixture
def labels(frame):
    df = frame(HISTORY, "player_id string, league string, season string, minutes int")
    return label.season_labels(df)


def test_labels(labels):
    rows = {(r["player_id"], r["season"]): (r["label"], r["breakout_league"], r["breakout_season"]) for r in labels.collect()}
    assert rows == {
        ("pA", "2018-19"): (1, "premier-league", "2021-22"),
        ("pA", "2019-20"): (1, "premier-league", "2021-22"),
        ("pB", "2018-19"): (0, None, None),
        ("pB", "2019-20"): (0, None, None),
        ("pC", "2019-20"): (0, None, None),
    }


def test_earliest_target_wins_and_display_names_work(frame):
    rows = [("p", "Eredivisie", "2018-2019", 900), ("p", "Serie A", "2021-2022", 900), ("p", "Ligue 1", "2020-2021", 900),
            ("p", "La Liga", "2020-2021", 900), ("p", "Bundesliga", "2019-2020", 899)]
    found = label.season_labels(frame(rows, "player_id string, league string, season string, minutes int")).collect()
    assert [(r["label"], r["breakout_league"], r["breakout_season"]) for r in found] == [(1, "La Liga", "2020-2021")]


def test_single_class_and_totals(labels):
    assert [r["season"] for r in label.single_class_periods(labels, "season").collect()] == []
    totals = label.label_totals(labels).first()
    assert (totals["observations"], totals["positives"], totals["negatives"]) == (5, 2, 3)


@pytest.fixture
def people(frame):
    years = range(2016, 2023)
    rows = [(f"p{i}", f"{y}-{(y + 1) % 100:02d}", y, int(i == 0)) for i in range(10) for y in years]
    return frame(rows, "player_id string, season string, year int, label int")


def test_folds(people):
    folds = label.walk_forward_folds(people, F.col("year"))
    sizes = {(r["fold"], r["split"]): r["count"] for r in folds.groupBy("fold", "split").count().collect()}
    assert sizes == {
        (1, "train"): 20, (1, "val"): 10, (1, "test"): 10, (2, "train"): 30, (2, "val"): 10, (2, "test"): 10,
        (3, "train"): 40, (3, "val"): 10, (3, "test"): 10,
    }
    report = label.leakage_report(folds, "player_id", "season", F.col("year")).collect()
    assert [r["warnings"] for r in report] == [""] * 3


@pytest.mark.parametrize(
    "folds, warning",
    [
        ([(1, 2018, 2018, 2020)], "train overlaps val"),
        ([(1, 2019, 2020, 2019)], "train overlaps test"),
        ([(1, 2017, 2020, 2019)], "val overlaps test"),
        ([(1, 2017, 2018, 2050)], ""),
    ],
)
def test_leaks_are_named(people, folds, warning):
    placed = label.walk_forward_folds(people, F.col("year"), folds)
    report = label.leakage_report(placed, "player_id", "season", F.col("year")).first()
    assert warning in report["warnings"] and bool(warning) == bool(report["warnings"])
    if "train overlaps val" == warning:
        assert report["shared_keys"] == 10
