import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import match

KEY = "player_id string, name string, team string, league string, season string"
BASE = [
    ("f1", "Ulo Vandremer", "Rovers", "eredivisie", "2021-22", None, None, None),
    ("f2", "Pell Ostrava", "Rovers", "eredivisie", "2021-22", 16.0, None, None),
    ("f3", "Quirien Moss", "Harbour", "eredivisie", "2021-22", None, None, None),
]
MARKET = [
    ("m1", "Ulo Vandremer", "Rovers", "eredivisie", "2021-22", 25000000),
    ("m2", "Pell Ostrava", "Rovers", "eredivisie", "2021-22", 8000000),
    ("m3", "Quiriën Moss", "Harbour", "eredivisie", "2021-22", 20000000),
]
EXPECTED = [
    ("u1", "Ulo Vandremer", "Rovers", "eredivisie", "2021-22", 15.8, 10.2, 12.4, 8.5, 0.50, 98),
    ("u2", "Pell Ostrava", "Rovers", "eredivisie", "2021-22", 9.9, 4.4, 7.7, 6.6, 0.30, 60),
]


def brute_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200.0 * table[-1][-1] / (len(a) + len(b)) if a and b else 0.0


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("Dušan Vlahović", "dusan vlahovic"), ("O'Brien Jr.", "obrien jr"), ("Pierre-Emerick", "pierre-emerick"),
        (None, ""), ("Øzil Æ ß", "ozil ae ss"), ("  A\tB ", "ab"),
    ],
)
def test_normalize_name(frame, raw, plain):
    assert frame([(raw,)], "n string").select(text.normalize_name(F.col("n"))).first()[0] == plain


def test_scores(frame):
    rows = [
        ("Ulo Vandremer", "Ulo Vandremer", "Rovers", "Rovers"), ("Ulo Vandremer", "U. Vandremer", "Rovers", "Rovers"),
        ("Ulo Vandremer", "Horatio Blint", "Rovers", "Seagate"), ("", "X", "Rovers", "Rovers"), ("A B", "A B", None, None),
    ]
    df = frame(rows, "a string, b string, s string, t string")
    scores = [r[0] for r in df.select(text.match_score(*[F.col(c) for c in "abst"])).collect()]
    assert scores[0] == 100 and scores[1] == pytest.approx(93.33, abs=0.01) and scores[2] < 50
    assert scores[3] == 0 and scores[4] == 80


def test_similarity_against_brute_force(frame):
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("abc d") for _ in range(rng.randint(0, 30))) for _ in range(2)) for _ in range(200)]
    got = [r[0] for r in frame(pairs, "a string, b string").select(text.similarity("a", "b")).collect()]
    assert got == pytest.approx([brute_ratio(a, b) for a, b in pairs])


def test_match_sources(frame):
    base = frame(BASE, KEY + ", xg double, npxg double, xg_assist double")
    market = frame(MARKET, KEY + ", market_value_eur bigint")
    expected = frame(EXPECTED, KEY + ", xg double, xa double, npxg double, xg_chain double, xg_per90 double, shots int")
    rows = {r["player_id"]: r for r in match.match_sources(base, market, expected).collect()}
    assert len(rows) == 3 and rows["f3"]["market_value_eur"] == 20000000
    assert rows["f1"]["match_confidence_tm"] == 100 and rows["f1"]["xg"] == 15.8 and rows["f1"]["xg_assist"] == 10.2
    assert rows["f2"]["xg"] == 16.0 and rows["f2"]["npxg"] == 7.7
    assert rows["f1"]["us_xg_per90"] == 0.50 and rows["f1"]["us_shots"] == 98
    assert rows["f3"]["match_confidence_us"] is None and rows["f3"]["xg"] is None


def test_other_block_does_not_match(frame):
    base = frame([b[:5] for b in BASE], KEY)
    other = frame([(*m[:3], "championship", "2021-22") for m in MARKET], KEY)
    found = match.best_match(base, other, ["league", "season"], "player_id")
    assert found.count() == 3 and found.where("match_id is not null").count() == 0


@pytest.mark.parametrize("threshold", [70.0, 80.0, 93.0])
def test_no_match_is_lost(frame, threshold):
    """The letter combinations find every best match that comparing all pairs finds; one block is hot."""
    rng = random.Random(11)
    names = ["anna bell", "jon snow", "marcus de la torre", "ole", "li", "bartholomew quincy", "joao felix", "x y z"]

    def spoil(name):
        letters = list(name)
        for _ in range(rng.randint(0, 4)):
            place = rng.randrange(len(letters)) if letters else 0
            letters[place : place + rng.randint(0, 1)] = rng.choice(["", "a", "e", "q"])
        return "".join(letters)

    def rows(n, prefix):
        return [
            (f"{prefix}{i:03d}", spoil(rng.choice(names)), rng.choice(["red", "blue town", "", None]), "hot" if i % 3 else "cold")
            for i in range(n)
        ]

    left, right = rows(150, "l"), rows(150, "r")
    schema = "id string, name string, team string, block string"
    found = match.best_match(frame(left, schema), frame(right, schema), ["block"], "id", threshold=threshold).collect()
    assert len(found) == len(left)
    for row in found:
        best = (threshold, None)
        for i, name, team, block in right:
            a, b = row["name"].strip(), name.strip()
            if block != row["block"] or not a or not b:
                continue
            score = brute_ratio(a, b) * 0.8 + brute_ratio(row["team"] or "", team or "") * 0.2
            if score > best[0] or (score >= best[0] and best[1] is None):
                best = (score, i)
        assert (row["match_id"], row["match_confidence"]) == (best[1], pytest.approx(best[0]) if best[1] else None)
