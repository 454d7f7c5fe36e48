"""Small awkward tables for the operators' tests."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeèñ") for _ in range(rng.randint(1, 7)))
    base = " ".join(word() for _ in range(120))
    rows = [(0, None, "en", "a", None), (1, "", "en", "a", 0), (2, " \t\n ", None, None, 4), (None, base, "en", None, 5),
            (None, None, None, None, None), (3, base, "en", "b", 9), (3, base, "en", "b", 9), (4, base, "en", "b", 9),
            (5, base.replace(" ", "\n", 3), "en", "b", 9), (6, "x", "fr", "c", 1), (7, "A b C", "fr", "c", 5),
            (8, "a\x1cb\x85c d e", "fr", "c", 5), (9, "Long " + " ".join(word() for _ in range(30000)), "de", "b", 1)]
    rows += [(10 + i, " ".join(word() for _ in range(rng.randint(1, 90))), rng.choice(["en", "fr", "de"]),
              rng.choice(["a", "b", "c", "d", "\U0001F600"]), 3) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
