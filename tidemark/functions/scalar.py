"""Column expressions for parsing, safe arithmetic and display. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6

# Accepted date layouts, tried in this order.
DATE_LAYOUTS = ("MMM d, yyyy", "d.M.yyyy", "yyyy-M-d", "d/M/yyyy")


def start_year(period: Column) -> Column:
    """Sort key of an ordinal period: '2019-20' and '2019-2020' are both 2019."""
    return F.split(period, "-")[0].cast("int")


def _blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when((trimmed != "") & (trimmed != "-"), trimmed)


def number_text(text: Column) -> Column:
    """Text of a number without commas; blank and '-' are NULL."""
    return F.regexp_replace(_blank_to_null(text), ",", "")


def parse_number(text: Column, as_int: bool = False) -> Column:
    """'1,234' to 1234; blank, '-' and unparsable text to NULL; integer mode rejects '31.7'."""
    return number_text(text).try_cast("int" if as_int else "double")


def parse_money(text: Column) -> Column:
    """'€25.00m' to 25000000, '€500k' to 500000, '-' to NULL. A comma counts as a decimal point."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(_blank_to_null(text), "€", ""), ",", "."))
    amount = F.trim(F.regexp_replace(plain, "[mk]", "")).try_cast("double")
    unit = F.when(plain.contains("m"), 1e6).when(plain.contains("k"), 1e3).otherwise(1.0)
    return (amount * unit).cast("long")


def parse_date(text: Column) -> Column:
    """Date in the first layout that fits, else NULL."""
    trimmed = _blank_to_null(text)
    return F.coalesce(*[F.try_to_date(trimmed, layout) for layout in DATE_LAYOUTS])


def parse_height_cm(text: Column) -> Column:
    """'1,85 m' to 185."""
    pattern = r"(\d)[,.](\d+)"
    metres = F.regexp_extract(text, pattern, 1).try_cast("int")
    centimetres = F.regexp_extract(text, pattern, 2).try_cast("int")
    return metres * 100 + centimetres


def extract(text: Column, pattern: str) -> Column:
    """First group of the pattern, NULL instead of an empty string where nothing matches. The text is searched once."""
    return F.get(F.array_remove(F.array(F.regexp_extract(text, pattern, 1)), ""), F.lit(0))


def safe_cast(value: Column, to: str, default=None) -> Column:
    """Cast with a default for missing and for unparsable input."""
    cast = value.try_cast(to)
    return cast if default is None else F.coalesce(cast, F.lit(default).cast(to))


def ratio(top: Column, bottom: Column) -> Column:
    """Division where a zero denominator gives NULL."""
    return F.try_divide(top, bottom)


def ratio_eps(top: Column, bottom: Column) -> Column:
    return top / (bottom + F.lit(EPSILON))


def rounded_rate(amount: Column, exposure: Column, digits: int = 2) -> Column:
    """Rate rounded for storage; NULL where there is no exposure."""
    return F.round(F.try_divide(amount, F.when(exposure > 0, exposure)), digits)


def clip(value: Column, low: float, high: float) -> Column:
    """Clip to a range; NULL stays NULL (``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def mapping(table: dict, key: Column, default: Column | None = None) -> Column:
    """Lookup in a small fixed table; a missing key gives ``default`` or NULL."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, default)


def first_token(text: Column, separator: str) -> Column:
    return F.trim(F.split(F.trim(text), separator)[0])


def position_group(position: Column, table: dict) -> Column:
    """Group of the first listed position; unknown, blank and NULL give NULL."""
    return mapping(table, first_token(position, ","))


def short_code(position: Column, table: dict) -> Column:
    """Group of the first short code; unknown text is kept as it is."""
    return mapping(table, first_token(position, r"\s+"), position)


def outcome_text(label: Column) -> Column:
    """Display text of a label: 1, 0, unknown."""
    return F.when(label == 1, "Breakout").when(label == 0, "-").otherwise("TBD")


def in_range_or_null(value: Column, low, high) -> Column:
    """NULL-tolerant range filter."""
    return value.between(low, high) | value.isNull()


def name_matches(name: Column, pattern: str) -> Column:
    """Case-insensitive search; the search text is a regular expression."""
    return name.rlike("(?i)" + pattern)


def age_at(period: Column, birth_year: Column) -> Column:
    return start_year(period) - birth_year


def percent(value: Column, digits: int = 1) -> Column:
    return F.round(value * 100, digits)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
