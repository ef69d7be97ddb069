"""Name normalisation and similarity. Arrow-batched: the built-ins have no transliteration or LCS."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that do not decompose into an ASCII letter and an accent.
UNDECOMPOSED = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L",
    "ı": "i", "ħ": "h", "Ħ": "H", "ŋ": "ng", "Ŋ": "NG", "ĸ": "k", "ŧ": "t", "Ŧ": "T", "ə": "@",
    "‘": "'", "’": "'", "–": "-", "—": "--", "“": '"', "”": '"',
}
_LETTERS = str.maketrans(UNDECOMPOSED)


@F.pandas_udf(T.StringType())
def to_ascii(text: pd.Series) -> pd.Series:
    """Transliterate to ASCII; characters without a Latin base are dropped."""

    def fold(value):
        if value is None or value.isascii():
            return value
        decomposed = unicodedata.normalize("NFKD", value.translate(_LETTERS))
        return decomposed.encode("ascii", "ignore").decode("ascii")

    return text.map(fold, na_action="ignore")


def normalize_name(text: Column) -> Column:
    """ASCII, lower case, outer blanks off, then only letters, digits, blanks and hyphens stay."""
    folded = F.trim(F.lower(to_ascii(text)), F.lit(" \t\r\n"))
    return F.coalesce(F.regexp_replace(folded, "[^a-z0-9 -]", ""), F.lit(""))


def _codes(texts: np.ndarray, width: int) -> np.ndarray:
    """Characters as a (row, position) matrix, padded with zero."""
    return texts.astype(f"<U{width}").view(np.uint32).reshape(len(texts), width)


def indel_ratio(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """200 * LCS / (|a| + |b|) for each pair; 0 if either text is empty.

    One dynamic programme over all pairs of the batch at once, a row of the table per step.
    """
    lengths_a = np.char.str_len(left)
    lengths_b = np.char.str_len(right)
    result = np.zeros(len(left))
    filled = (lengths_a > 0) & (lengths_b > 0)
    if not filled.any():
        return result
    size_a, size_b = lengths_a[filled], lengths_b[filled]
    a, b = _codes(left[filled], int(size_a.max())), _codes(right[filled], int(size_b.max()))
    rows = np.arange(len(a))
    best = np.zeros((len(a), b.shape[1] + 1), dtype=np.int32)
    for i in range(a.shape[1]):
        active = a[:, i] != 0
        grown = best[:, :-1] + ((a[:, i : i + 1] == b) & active[:, None])
        best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], grown), axis=1)
    lcs = best[rows, size_b]
    result[filled] = 200.0 * lcs / (size_a + size_b)
    return result


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Normalised Indel similarity, 0 to 100."""
    if left.empty:
        return pd.Series(dtype="float64")
    a = left.fillna("").to_numpy(dtype=str)
    b = right.fillna("").to_numpy(dtype=str)
    # Pairs of similar length share a batch, so that one long text does not widen all tables.
    order = np.argsort(np.char.str_len(a) + np.char.str_len(b), kind="stable")
    result = np.zeros(len(a))
    for start in range(0, len(order), 2048):
        part = order[start : start + 2048]
        result[part] = indel_ratio(a[part], b[part])
    return pd.Series(result)


def record_score(name_similarity: Column, team_similarity: Column) -> Column:
    """Weighted record score: 0.8 of the name and 0.2 of the team."""
    return name_similarity * 0.8 + team_similarity * 0.2


def match_score(name1: Column, name2: Column, team1: Column, team2: Column) -> Column:
    """Score of two raw records, 0 if a name is empty, team part 0 if a team is empty."""
    n1, n2 = normalize_name(name1), normalize_name(name2)
    t1, t2 = normalize_name(team1), normalize_name(team2)
    return F.when((n1 == "") | (n2 == ""), F.lit(0.0)).otherwise(
        record_score(similarity(n1, n2), similarity(t1, t2))
    )
