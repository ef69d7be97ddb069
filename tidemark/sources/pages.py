"""Typed rows from raw pages: stat tables, paged listings, profile pages, embedded JSON.

Each page is one row and is taken apart by built-in regular expressions, so the work spreads over the
pages and no parser runs outside the engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import (
    extract,
    parse_date,
    parse_height_cm,
    parse_money,
    rounded_rate,
    safe_cast,
    short_code,
)
from tidemark.sources import config
from tidemark.sources.tables import COUNTS_SCHEMA

# The character references that occur in table text.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}

PLAYER_ID = r"/players/([a-f0-9]+)/"
LISTED_ID = r"/spieler/(\d+)"
LISTED_SLUG = r"^/([^/]+)/"

_NUMBERS = {f.name: isinstance(f.dataType, T.IntegerType) for f in COUNTS_SCHEMA if not isinstance(f.dataType, T.StringType)}


def _between(first: str, last: str) -> list[str]:
    names = [f.name for f in COUNTS_SCHEMA]
    return names[names.index(first) : names.index(last) + 1]


# Stat columns of each table, as ranges of the declared schema.
STAT_TABLES = {
    "stats_standard": _between("age", "progressive_passes_received"),
    "stats_shooting": _between("shots", "npxg_net"),
    "stats_passing": _between("passes_completed", "crosses_into_penalty_area"),
    "stats_defense": _between("tackles", "errors"),
    "stats_possession": [*_between("touches", "passes_received"), "progressive_carries", "progressive_passes_received"],
}


def uncomment_tables(html: Column) -> Column:
    """Make tables visible that the page hides in comments."""
    return F.regexp_replace(html, r"(?is)<!--\s*(<div\b[^>]*\btable_container\b.*?)-->", "$1")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(html: Column) -> Column:
    """Text without tags and outer blanks, character references resolved."""

    def plain(whole: Column) -> Column:
        return F.when(whole.contains("<"), F.regexp_replace(whole, r"<[^>]*>", "")).otherwise(whole)

    def resolved(text: Column) -> Column:
        found = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), REFERENCES.items(), text)
        return F.trim(F.when(text.contains("&"), found).otherwise(text), F.lit(" \t\r\n\f\u00a0"))

    return _let(_let(html, plain), resolved)


def number_in(html: Column) -> Column:
    """Text of a number without tags and commas. A blank or '-' is no number, and the cast says so."""
    return F.when(html.contains("<") | html.contains(","), F.regexp_replace(html, "<[^>]*>|,", "")).otherwise(html)


# One attribute of a tag, from the tag's name or the attribute before it; names without a value may precede it.
_ATTRIBUTE = (
    r"""(<[A-Za-z][A-Za-z0-9]*|\G(?!\A))((?:\s+[^\s=>"'/]+)*?\s+[^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^'"]*)'|([^\s"'>]+))"""
)
_BLOCK = 64


def _running(changes: Column) -> Column:
    """Running total of an array of numbers, in blocks, so that many numbers stay cheap."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, b: a + b)

    def within(offsets: Column) -> Column:
        def at(i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            return F.get(offsets, block) + total(F.slice(changes, block * _BLOCK + 1, i - block * _BLOCK + 1))

        return F.transform(changes, lambda _, i: at(i))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(changes) - 1) / _BLOCK).cast("int")),
        lambda b: total(F.slice(changes, b * _BLOCK + 1, _BLOCK)),
    )
    return _let(_let(blocks, lambda found: F.transform(found, lambda _, b: total(F.slice(found, F.lit(1), b)))), within)


def table_segments(html: Column) -> Column:
    """The page cut at its table tags: structs of ``part`` and ``depth``, the tables open inside the part.

    Attributes are written with double quotes first, whatever their quotes were, and comments are left out.
    A value in single quotes that holds a double quote stays as it is. NULL for a null page.
    """
    plain = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    quoted = F.regexp_replace(plain, _ATTRIBUTE, '$1$2="$3$4$5"')
    change = lambda part: F.when(part.rlike(r"^(?i)<table\b"), 1).when(part.rlike(r"^(?i)</table\b"), -1).otherwise(0)

    def measured(parts: Column) -> Column:
        depths = _let(F.transform(parts, change), _running)
        return F.arrays_zip(parts.alias("part"), depths.alias("depth"))

    return _let(F.split(quoted, r"(?i)(?=</?table\b)"), measured)


def table_body(segments: Column, attribute: str, value: str, cells: bool = True) -> Column:
    """Body of the first table whose attribute is the value, or else contains it; NULL without such a table or body.

    A class is a word of its attribute.
    Only the table's own body counts, never that of another one. Rows of tables nested in its cells are
    renamed, and with ``cells`` their cells too, so that every row and cell that is left is the table's own.
    """
    nested = "table|thead|tbody|tfoot|tr|th|td" if cells else "table|thead|tbody|tfoot|tr"

    def place(pattern: str) -> Column:
        opened = rf'^(?s)(?i:<table)\b[^>]*\b(?i:{attribute})="{pattern}"'
        return F.array_position(F.transform(segments, lambda s: s["part"].rlike(opened)), True)

    def own(start: Column) -> Column:
        later = F.slice(segments, start, F.greatest(F.size(segments) - start + 1, F.lit(0)))

        def body(rest: Column) -> Column:
            depth = rest[0]["depth"]
            closed = F.array_position(F.transform(rest, lambda s: s["depth"] < depth), True).cast("int")
            parts = F.transform(
                _let(closed, lambda end: F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest)),
                lambda s: F.when(s["depth"] > depth, F.regexp_replace(s["part"], rf"(?i)<(/?)({nested})\b", "<$1x-$2"))
                .when(s["part"].startswith("</"), F.regexp_replace(s["part"], r"(?i)^</table\b", "</x-table"))
                .otherwise(s["part"]),
            )
            return extract(F.array_join(parts, ""), r"(?is)<tbody\b[^>]*>(.*?)(?:</tbody\s*>|\z)")

        return F.when(start > 0, _let(later, body))

    if attribute == "class":
        found = place(rf"(?:[^\"]*\s)?{value}(?:\s[^\"]*)?")
    else:
        found = _let(place(value), lambda exact: F.when(exact > 0, exact).otherwise(place(rf"[^\"]*{value}[^\"]*")))
    return _let(found.cast("int"), own)


def table_rows(pages: DataFrame, body: Column) -> DataFrame:
    """One row per table row: page columns, ``row_no``, ``row_html``; repeated header rows are skipped.

    A row ends at its end tag, at the next row or at the end of the body.
    """
    rows = F.regexp_extract_all(body, F.lit(r"(?is)(<tr\b.*?)(?=<tr\b|</tr\b|\z)"), F.lit(1))
    exploded = pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(rows).alias("row_no", "row_html"))
    return exploded.where(~F.col("row_html").rlike(r'^(?i:<tr)\b[^>]*(?i:class)="[^"]*\bthead\b'))


def link_text(html: Column) -> Column:
    return text_of(extract(html, r"(?is)(<a\b.*?</a>)"))


def player_rows(pages: DataFrame, tables: list[str]) -> DataFrame:
    """Rows of the named stat tables in one pass over the pages.

    Columns: the page columns, ``table``, ``row_no``, ``player_id`` from the player link, and for the
    ``data-stat`` cells of the row their names, inner HTML and number texts. Rows without a link are
    skipped, and rows of the standard table with fewer than ten cells.
    """
    kept = [c for c in pages.columns if c != "html"]
    visible = pages.select(*kept, table_segments(uncomment_tables(F.col("html"))).alias("_segments"))
    bodies = F.array(
        *[F.struct(F.lit(t).alias("table"), table_body(F.col("_segments"), "id", t).alias("_body")) for t in tables]
    )
    found = visible.select(*kept, F.inline(bodies)).where(F.col("_body").isNotNull())
    rows = table_rows(found, F.col("_body")).drop("_body")
    row = F.col("row_html")
    whole = F.regexp_extract_all(row, F.lit(r'(?is)<t[hd]\b[^>]*\bdata-stat="[^"]*"[^>]*>.*?(?=</?t[hdr]\b|\z)'), F.lit(0))
    tag = r'(?is)\A<t[hd]\b[^>]*\bdata-stat="([^"]*)"[^>]*>(.*)\z'

    def named(found: Column) -> Column:
        names, cells = [F.transform(found, lambda c: F.regexp_extract(c, tag, group)) for group in (1, 2)]
        return F.struct(names.alias("names"), cells.alias("cells"))

    def linked(own: Column) -> Column:
        player = F.get(own["cells"], (F.array_position(own["names"], "player") - 1).cast("int"))
        return F.struct(
            extract(player, rf'(?i:href)="[^"]*{PLAYER_ID}').alias("player_id"),
            own["names"].alias("names"),
            own["cells"].alias("cells"),
            F.transform(own["cells"], number_in).alias("numbers"),
        )

    enough = F.size(F.regexp_extract_all(row, F.lit(r"(?i)(<t[hd]\b)"), F.lit(1))) >= 10
    valid = lambda own: own["player_id"].isNotNull() & ((F.col("table") != "stats_standard") | enough)
    # A row is taken apart inside the generator: as a filter on columns it would be for every use of them.
    return rows.select(*kept, "table", "row_no", F.inline(F.filter(F.array(_let(_let(whole, named), linked)), valid)))


def _value(row: str, field: str, name: str) -> Column:
    """Entry of the first cell of that name in a row struct, NULL where the row has none."""
    place = (F.array_position(F.col(f"{row}.names"), name) - 1).cast("int")
    return F.get(F.col(f"{row}.{field}"), place)


def _stat(row: str, name: str) -> Column:
    return _value(row, "numbers", name).try_cast("int" if _NUMBERS[name] else "double")


def _identity(row: str) -> list[Column]:
    player, nation, position, team = [_value(row, "cells", c) for c in ("player", "nationality", "position", "team")]
    return [
        link_text(player).alias("name"),
        link_text(nation).alias("nationality"),
        text_of(position).alias("position"),
        F.coalesce(link_text(team), text_of(team)).alias("team"),
    ]


def stat_table(pages: DataFrame, table: str) -> DataFrame:
    """Rows of one stat table with typed numbers."""
    kept = [c for c in pages.columns if c != "html"]
    rows = player_rows(pages, [table]).withColumn("_row", F.struct("names", "cells", "numbers"))
    identity = _identity("_row") if table == "stats_standard" else []
    stats = [_stat("_row", c).alias(c) for c in STAT_TABLES[table]]
    return rows.select(*kept, "row_no", "player_id", *identity, *stats)


def counts_records(pages: DataFrame, page_columns: list[str]) -> DataFrame:
    """All five stat tables of the pages, merged by player; a later table overwrites shared columns.

    One scan and one shuffle: each player keeps the last row of each table, and the columns are read
    from these at most five rows.
    """
    key = [*page_columns, "player_id"]
    row = F.struct("names", "cells", "numbers")

    def last(table: str) -> Column:
        here = F.col("table") == table
        return F.max_by(F.when(here, row), F.when(here, F.col("row_no"))).alias(table)

    players = player_rows(pages, list(STAT_TABLES)).groupBy(*key).agg(*[last(t) for t in STAT_TABLES])
    base, *others = STAT_TABLES
    values = {c: _stat(base, c) for c in STAT_TABLES[base]}
    for table in others:
        for c in STAT_TABLES[table]:
            if c in values:
                values[c] = F.when(F.col(table).isNotNull(), _stat(table, c)).otherwise(values[c])
            else:
                values[c] = _stat(table, c)
    return players.where(F.col(base).isNotNull()).select(
        *key, *_identity(base), *[value.alias(c) for c, value in values.items()]
    )


def listing_records(pages: DataFrame) -> DataFrame:
    """Rows of a paged listing: id, slug, name, position, age, nationality, team, market value."""
    kept = [c for c in pages.columns if c != "html"]
    cut = pages.select(*kept, table_segments(F.col("html")).alias("_segments"))
    body = table_body(F.col("_segments"), "class", "items", cells=False)
    rows = table_rows(cut, body).drop("_segments").where(F.col("row_html").rlike(r'^(?i:<tr)\b[^>]*(?i:class)="[^"]*\b(odd|even)\b'))
    row = F.col("row_html")
    cell = r'(?s)(?i:<td)\b[^>]*(?i:class)="{}"[^>]*>'
    link = extract(row, cell.format(r'[^"]*\bhauptlink\b[^"]*') + r"(?i:.*?(<a\b.*?</a>))")
    texts = F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>(.*?)(?=</?t[dr]\b|\z)"), F.lit(1)), text_of)
    position = F.get(F.filter(texts, lambda t: t.isin(config.LISTED_POSITIONS)), F.lit(0))
    age = text_of(extract(row, cell.format(r'[^"]*\bzentriert\b[^"]*') + r"(.*?)(?i:(?=</?t[dr]\b|\z))"))
    team = extract(row, r'(?s)((?i:<a)\b[^>]*(?i:class)="[^"]*\bvereinprofil_tooltip\b[^"]*".*?(?i:</a>))')
    worth = text_of(extract(row, cell.format("rechts hauptlink") + r"(.*?)(?i:(?=</?t[dr]\b|\z))"))

    def named(own: Column) -> Column:
        return _let(
            extract(own, r'(?i)href="([^"]*)"'),
            lambda href: F.struct(
                extract(href, LISTED_ID).alias("player_id"),
                extract(href, LISTED_SLUG).alias("player_slug"),
                text_of(own).alias("name"),
            ),
        )

    # A row is searched inside the generator: as a filter on columns it would be for every use of them.
    linked = F.inline(F.filter(F.array(_let(link, named)), lambda own: own["player_id"].isNotNull()))
    return rows.select(*kept, "row_no", "row_html", linked).select(
        *kept,
        "row_no",
        "player_id",
        "player_slug",
        "name",
        position.alias("position"),
        _let(age, lambda t: F.when(t.rlike(r"^\d+$"), t.cast("int"))).alias("age"),
        extract(row, r'(?i:<img)\b[^>]*(?i:class)="[^"]*\bflaggenrahmen\b[^"]*"[^>]*(?i:title)="([^"]*)"').alias("nationality"),
        _let(team, lambda t: F.coalesce(extract(t, r'^(?i:<a)\b[^>]*(?i:title)="([^"]*)"'), text_of(t))).alias("team"),
        _let(worth, parse_money).alias("market_value_eur"),
    )


def first_listed(records: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per id over all pages of a listing."""
    from tidemark.operators.unify import latest_per_key

    return latest_per_key(records, keys, order)


def profile_records(pages: DataFrame) -> DataFrame:
    """Fields of a profile page, chosen by the label that precedes each value."""
    block = F.lit(r'(?is)info-table__content--label[^>]*>(.*?)</span>\s*<span\b[^>]*info-table__content[^>]*>(.*?)</span>')
    labels = F.transform(F.regexp_extract_all("html", block, F.lit(1)), lambda t: F.lower(text_of(t)))
    values = F.transform(F.regexp_extract_all("html", block, F.lit(2)), text_of)
    fields = pages.withColumns({"_pairs": F.arrays_zip(labels.alias("label"), values.alias("value"))})

    def field(label: str) -> Column:
        found = F.filter("_pairs", lambda pair: pair["label"].contains(label))
        return F.get(found, F.lit(0))["value"]

    worth = extract(F.col("html"), r'(?is)<div\b[^>]*tm-player-market-value-development__current-value[^>]*>(.*?)</div>')
    return fields.select(
        *[c for c in pages.columns if c != "html"],
        parse_date(field("date of birth")).alias("date_of_birth"),
        parse_height_cm(field("height")).alias("height_cm"),
        F.lower(field("foot")).alias("foot"),
        field("citizenship").alias("nationality"),
        field("position").alias("position"),
        parse_date(field("contract expires")).alias("contract_expires"),
        parse_money(text_of(worth)).alias("market_value_eur"),
    )


# Fields of an embedded record, all of them text.
RECORD_FIELDS = [
    "id", "player_name", "games", "time", "goals", "xG", "assists", "xA", "shots", "key_passes", "yellow_cards",
    "red_cards", "position", "team_title", "npg", "npxG", "xGChain", "xGBuildup",
]


def embedded_json(html: Column, variable: str = "playersData") -> Column:
    """The JSON text assigned to a script variable, wrapped in JSON.parse or plain."""
    return extract(html, rf"(?s){variable}\s*=\s*(?:JSON\.parse\(')?(\[.*?\])(?:'\))?\s*;")


def json_records(pages: DataFrame, json: Column) -> DataFrame:
    """Typed rows from a JSON array of records whose values are text."""
    schema = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in RECORD_FIELDS]))
    kept = [c for c in pages.columns if c != "html"]
    rows = pages.select(*kept, F.inline(F.from_json(json, schema)))
    typed = rows.select(
        *kept,
        F.coalesce("id", F.lit("")).alias("player_id"),
        F.coalesce("player_name", F.lit("")).alias("name"),
        short_code(F.col("position"), config.SHORT_CODES).alias("position"),
        F.col("team_title").alias("team"),
        safe_cast(F.col("games"), "int").alias("games"),
        safe_cast(F.col("time"), "int", 0).alias("minutes"),
        safe_cast(F.col("goals"), "int", 0).alias("goals"),
        safe_cast(F.col("assists"), "int", 0).alias("assists"),
        safe_cast(F.col("npg"), "int").alias("npg"),
        safe_cast(F.col("xG"), "double", 0.0).alias("xg"),
        safe_cast(F.col("xA"), "double", 0.0).alias("xa"),
        safe_cast(F.col("npxG"), "double", 0.0).alias("npxg"),
        safe_cast(F.col("xGChain"), "double").alias("xg_chain"),
        safe_cast(F.col("xGBuildup"), "double").alias("xg_buildup"),
        safe_cast(F.col("shots"), "int").alias("shots"),
        safe_cast(F.col("key_passes"), "int").alias("key_passes"),
        safe_cast(F.col("yellow_cards"), "int").alias("yellow_cards"),
        safe_cast(F.col("red_cards"), "int").alias("red_cards"),
    )
    units = F.greatest(F.col("minutes"), F.lit(0)) / 90.0
    return typed.withColumns(
        {
            "minutes_90s": F.round(units, 2),
            **{f"{c}_per90": rounded_rate(F.col(c), units) for c in ("xg", "xa", "npxg", "goals", "assists")},
            "xg_overperformance": F.round(F.col("goals") - F.col("xg"), 2),
            "xa_overperformance": F.round(F.col("assists") - F.col("xa"), 2),
        }
    )


def links(pages: DataFrame) -> DataFrame:
    """All link targets of a page with their position."""
    found = F.regexp_extract_all("html", F.lit(r'<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))
    return pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(found).alias("link_no", "href"))
