import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import source_queries
from tidemark.functions import scalar
from tidemark.sources import pages


def stat(name, value):
    return f'<td data-stat="{name}">{value}</td>'


def player(pid, name, cells, tag="th"):
    link = f'<{tag} class="left" data-stat="player" scope="row"><a href="/en/players/{pid}/x">{name}</a></{tag}>'
    return f"<tr>\n{link}\n" + "\n".join(stat(k, v) for k, v in cells.items()) + "</tr>"


STANDARD = {
    "nationality": '<a href="/c">nl NED</a>', "position": "FW,MF", "team": "<a>Rovers &amp; Co</a>", "age": "23", "birth_year": "2000",
    "games": "34", "games_starts": "32", "minutes": "2,856", "minutes_90s": "31.7", "goals": "21", "assists": "-", "xg": "15.8",
    "progressive_carries": "89",
}
PAGE = (
    '<html><table id="other"><tbody><tr><td>x</td></tr></tbody></table><table class="c" id="stats_standard_9">\n<thead><tr><th>P</th></tr></thead>\n<tbody>'
    + '<tr class="over thead"><th data-stat="player"><a href="/en/players/aaa/h">Header</a></th></tr>'
    + player("c0ffee12", "Ulo Vandremer", STANDARD)
    + player("decade34", "Short Row", {"age": "20"})
    + "<tr>" + stat("player", "No Link") + "".join(stat(f"c{i}", i) for i in range(12)) + "</tr>"
    + player("beef", "Td &#39;Player", {**STANDARD, "minutes": "", "goals": "31.7"}, "td")
    + '</tbody></table><!-- <div class="table_container" id="div_x">\n<table id="stats_shooting"><tbody>'
    + player("c0ffee12", "Ulo Vandremer", {"shots": "98", "shots_on_target": "45", "shots_per90": "3.09"})
    + player("fade", "Not In Base", {"shots": "1"})
    + '</tbody></table></div> --><table id="stats_possession"><tbody>'
    + player("c0ffee12", "Ulo Vandremer", {"touches": "1,900", "progressive_carries": ""})
    + "</tbody></table></html>"
)


def test_stat_tables(frame):
    df = frame([(1, PAGE), (2, "<html>nothing</html>")], "page_id int, html string")
    rows = {r["player_id"]: r for r in pages.counts_records(df, ["page_id"]).collect()}
    assert set(rows) == {"c0ffee12", "beef"}
    row = rows["c0ffee12"]
    assert (row["name"], row["nationality"], row["position"], row["team"]) == ("Ulo Vandremer", "nl NED", "FW,MF", "Rovers & Co")
    assert (row["minutes"], row["minutes_90s"], row["goals"], row["assists"], row["xg"]) == (2856, 31.7, 21, None, 15.8)
    assert (row["shots"], row["shots_per90"], row["touches"], row["tackles"]) == (98, 3.09, 1900, None)
    assert row["progressive_carries"] is None and rows["beef"]["progressive_carries"] == 89
    assert (rows["beef"]["name"], rows["beef"]["minutes"], rows["beef"]["goals"]) == ("Td 'Player", None, None)


def test_single_table(frame):
    df = frame([(1, PAGE)], "page_id int, html string")
    assert {r["player_id"] for r in pages.stat_table(df, "stats_shooting").collect()} == {"c0ffee12", "fade"}
    assert pages.stat_table(df, "stats_defense").count() == 0


LISTING = """<table class="items wide"><tbody>
<tr class="odd"><td class="hauptlink"> <a href="/ulo-vandremer/profil/spieler/710044">Ulo Vandremer</a></td><td>Left Winger</td>
<td class="zentriert">23</td><td><a class="vereinprofil_tooltip" title="Northwold Rovers">Rovers</a></td>
<td><img class="flaggenrahmen" title="Netherlands"></td><td class="rechts hauptlink">€45.00m</td></tr>
<tr class="even"><td class="hauptlink"><a href="/b-p/profil/spieler/820055">Thrifty Signing</a></td><td>Coach</td>
<td class="zentriert">?</td><td><a class="vereinprofil_tooltip">Millbrook</a></td><td class="rechts hauptlink">€800k</td></tr>
<tr class="odd"><td class="hauptlink"><a href="/no-id/">No Id</a></td></tr>
<tr class="bg"><td class="hauptlink"><a href="/x/profil/spieler/1">Other Row</a></td></tr></tbody></table>"""


def test_listing(frame):
    rows = pages.listing_records(frame([(1, LISTING)], "page_no int, html string")).orderBy("row_no").collect()
    assert [r["player_id"] for r in rows] == ["710044", "820055"]
    first, second = rows
    assert (first["player_slug"], first["name"], first["position"], first["age"]) == ("ulo-vandremer", "Ulo Vandremer", "Left Winger", 23)
    assert (first["nationality"], first["team"], first["market_value_eur"]) == ("Netherlands", "Northwold Rovers", 45000000)
    assert (second["position"], second["age"], second["team"], second["market_value_eur"]) == (None, None, "Millbrook", 800000)


WILD = """<TABLE><tr><td>
<table class='wide items' data-n=3><thead><tr><th>x</th></tr></thead><tbody>
<tr class='odd'><td class=zentriert>7</td><td class='posrela'><table class="inline-table"><tr><td rowspan="2"><img src='a'></td>
<td class='hauptlink'><a title="T" href='/ada-quill/profil/spieler/31'>Ada Quill</a></td></tr><tr><td>Goalkeeper</td></tr></table></td>
<td><IMG class="flaggenrahmen" title='Malta'></td><td><a class='vereinprofil_tooltip' title='Harbour Town'>H</a></td><td class = 'rechts hauptlink'>€1.20m</td>
<TR CLASS="even"><td class="hauptlink"><A HREF="/bo-lane/profil/spieler/32">Bo Lane</A></td><td class="zentriert">30</td></TR>
</tbody></table></td></tr></TABLE><table class="items"><tbody><tr class="odd"><td class="hauptlink"><a href="/z/profil/spieler/9">Z</a></td></tr></tbody></table>"""


def test_listing_of_nested_tables(frame):
    rows = pages.listing_records(frame([(1, WILD), (2, None), (3, "")], "page_no int, html string")).orderBy("row_no").collect()
    assert [(r["player_id"], r["player_slug"], r["name"]) for r in rows] == [("31", "ada-quill", "Ada Quill"), ("32", "bo-lane", "Bo Lane")]
    first, second = rows
    assert (first["position"], first["age"], first["nationality"], first["team"], first["market_value_eur"]) == ("Goalkeeper", 7, "Malta", "Harbour Town", 1200000)
    assert (second["age"], second["team"], second["market_value_eur"]) == (30, None, None)


def stats_page(attributes, body):
    return f"<table {attributes}>{body}</table>"


def test_own_body_only(frame):
    """A table without a body has no rows; it does not take those of the next table or of a nested one."""
    full = "<tbody>" + player("abc1", "Next Table", {"shots": "5"}) + "</tbody>"
    cases = [
        (1, stats_page('id="stats_shooting"', player("abc0", "No Body", {"shots": "4"})) + stats_page('id="other"', full)),
        (2, stats_page('id="stats_shooting"', f"<tr><td>{stats_page('id=x', full)}</td></tr>")),
        (3, stats_page('id="stats_shooting_old"', full) + stats_page("id='stats_shooting'", full.replace("abc1", "abc2"))),
        (4, stats_page("ID=9 id = stats_shooting_7", full.upper().replace("ABC1", "abc3").replace("/EN/PLAYERS/", "/en/players/").replace('"PLAYER"', '"player"').replace('"SHOTS"', '"shots"'))),
        (5, stats_page('id="stats_shooting"', "<tbody>" + player("abc5", "Open End", {"shots": "6"}))),
        (6, "<!-- " + stats_page('id="stats_shooting"', full) + " -->"),
    ]
    found = pages.stat_table(frame(cases, "page_id int, html string"), "stats_shooting").collect()
    assert sorted((r["page_id"], r["player_id"], r["shots"]) for r in found) == [(3, "abc2", 5), (4, "abc3", 5), (5, "abc5", 6)]


def test_cells_with_nested_tables(frame):
    inner = "<table><tbody><tr><td data-stat='shots'>99</td></tr></tbody></table>"
    link = "<th data-stat='player'><a href='/en/players/f00d/x'>Inner Table</a></th>"
    row = f"<tr>{link}<td data-stat='note'>{inner}</td><td data-stat='shots'>3<td data-stat='shots_on_target'>2</tr>"
    page = stats_page("id='stats_shooting'", f"<tbody>{row}{row.replace('f00d', 'feed')}</tbody>")
    found = pages.stat_table(frame([(1, page)], "page_id int, html string"), "stats_shooting").collect()
    assert [(r["player_id"], r["shots"], r["shots_on_target"]) for r in found] == [("f00d", 3, 2), ("feed", 3, 2)]


def test_depth_of_many_tables(frame):
    """Depths against plain counting, over more tags than one block holds."""
    import random

    draw = random.Random(4)
    tags = [draw.choice(["<table>", "</table>", "<TABLE id='a'>", "<p>"]) for _ in range(500)]
    found = frame([("".join(tags),)], "html string").select(pages.table_segments(F.col("html")).alias("s")).first()["s"]
    expected, depth = [], 0
    for tag in tags:
        if "table" in tag.lower():
            depth += -1 if tag.startswith("</") else 1
            expected.append(depth)
    assert [s["depth"] for s in found if s["part"].lower().lstrip("</").startswith("table")] == expected


def test_rows_are_searched_once(frame):
    """Filters and columns share what they find in a row; each pattern stands once in the plan."""
    df = frame([(1, PAGE)], "page_id int, html string")
    plan = lambda found: found._jdf.queryExecution().optimizedPlan().toString()
    assert plan(pages.listing_records(df)).count(r"\bhauptlink\b") == 1
    assert plan(pages.player_rows(df, ["stats_standard"])).count("data-stat=") == 3
    assert plan(df.select(scalar.extract(F.col("html"), "needle(.)").alias("x"))).count("needle") == 1


def test_listing_pages_are_spread(spark, tmp_path):
    row = "id AS p_partkey, 'a b' AS p_name, 'brand' AS p_brand, 'type' AS p_type, 30 AS p_size, 12.5D AS p_retailprice"
    spark.range(0, 500, numPartitions=1).selectExpr(*row.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    found = source_queries.listing_pages(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert pages.listing_records(found).count() == 500


def test_first_page_wins(frame):
    df = frame([(2, "7", "late"), (1, "7", "early")], "page_no int, player_id string, name string")
    assert pages.first_listed(df, ["player_id"], [F.col("page_no").asc()]).first()["name"] == "early"


def test_profile(frame):
    label = '<span class="info-table__content info-table__content--label">{}:</span> <span class="info-table__content bold">{}</span>'
    html = "".join(
        label.format(k, v)
        for k, v in {"Date of birth/Age": "Jan 1, 2000", "Height": "1,85 m", "Foot": "Right", "Citizenship": "<img> Spain", "Contract expires": "30.06.2026"}.items()
    )
    html += '<div class="tm-player-market-value-development__current-value">\n€1.50m </div>'
    row = pages.profile_records(frame([(html,)], "html string")).first()
    assert row["date_of_birth"] == datetime.date(2000, 1, 1) and row["height_cm"] == 185 and row["foot"] == "right"
    assert row["nationality"] == "Spain" and row["contract_expires"] == datetime.date(2026, 6, 30) and row["market_value_eur"] == 1500000
    assert row["position"] is None


def test_embedded_json(frame):
    html = """<script>var playersData = JSON.parse('[{"id":"1","player_name":"A","time":"900","goals":"10","xG":"8.5","assists":"x","position":"F M"},
    {"id":"2","player_name":"B","time":"0","goals":"1","xGChain":"2.5"}]');</script>"""
    df = frame([("l", html)], "league string, html string")
    a, b = pages.json_records(df, pages.embedded_json(F.col("html"))).orderBy("player_id").collect()
    assert (a["goals_per90"], a["xg_per90"], a["minutes_90s"], a["assists"], a["position"]) == (1.0, 0.85, 10.0, 0, "FW")
    assert a["xg_overperformance"] == 1.5 and a["games"] is None and a["league"] == "l"
    assert (b["goals_per90"], b["xg"], b["xg_chain"], b["shots"]) == (None, 0.0, 2.5, None)


@pytest.mark.parametrize("text, whole, value", [("1,234", 1234, 1234.0), ("", None, None), ("-", None, None), (" 31.7 ", None, 31.7), ("abc", None, None), (None, None, None)])
def test_numbers(frame, text, whole, value):
    row = frame([(text,)], "t string").select(scalar.parse_number(F.col("t"), True), scalar.parse_number(F.col("t"))).first()
    assert tuple(row) == (whole, value)


@pytest.mark.parametrize("text, value", [("€25.00m", 25000000), ("€500k", 500000), ("€1.50m", 1500000), ("-", None), ("1,500", 1), ("free", None), (None, None)])
def test_money(frame, text, value):
    assert frame([(text,)], "t string").select(scalar.parse_money(F.col("t"))).first()[0] == value


@pytest.mark.parametrize("text, ok", [("Jan 1, 2000", True), ("1.1.2000", True), ("2000-01-01", True), ("01/01/2000", True), ("-", False), ("soon", False)])
def test_dates(frame, text, ok):
    assert frame([(text,)], "t string").select(scalar.parse_date(F.col("t"))).first()[0] == (datetime.date(2000, 1, 1) if ok else None)


def test_link_parts(frame):
    df = frame([("/en/players/abc123/Name",), ("/name/profil/spieler/99",), ("/",)], "u string")
    got = df.select(scalar.extract(F.col("u"), pages.PLAYER_ID), scalar.extract(F.col("u"), pages.LISTED_ID), scalar.extract(F.col("u"), pages.LISTED_SLUG)).collect()
    assert [tuple(r) for r in got] == [("abc123", None, "en"), (None, "99", "name"), (None, None, None)]
