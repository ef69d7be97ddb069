import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hash string, found int, spans int, part int, score string, _text string, _id string, _spans string, rep int, n int, band string, _kept string, _row string"
SYLLABLES = "an er in th on re st en ou ti ha ed nd es le ra".split()


def prose(seed: int, n: int) -> str:
    """Invented words, the same for the same seed."""
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(n))


def wide(spark, rows):
    """Documents with further columns whose names the operators use inside, all null."""
    return spark.createDataFrame([(i, t, lang, None, None, *[None] * 14) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, very long texts and characters outside the basic plane."""
    long = prose(1, 30000)
    copy = prose(2, 200)
    near = copy.rsplit(" ", 2)[0] + " other ending"
    return [
        (10, None, "en"), (11, "", "en"), (12, " \n\t ", None), (13, "a", "en"), (14, "😀 é ﬁ\n😀", "xx"),
        (20, copy, "en"), (21, copy, None), (21, copy, None), (22, near, "en"), (23, copy.upper(), "en"),
        (30, long, "en"), (31, long[1000:], "fr"), (None, copy, "en"), (None, None, None), (40, "same", "en"), (40, "other text of one id", "en"),
        (41, "x" * 5000, "en"), (42, prose(3, 13), "en"), (43, prose(3, 13) + " tail", "en"), (44, "the the the the the the the the the the the the the the", "en"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return wide(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return wide(spark, [])
