"""Small tables with every odd case: nulls, empty and very long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("kept", "key", "n_words", "size", "target", "label", "rep", "ids", "pii_spans", "__row", "word", "rank", "host", "path", "a", "bits")


def random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["The", "of", "and", "river", "Fußball", "naïve", "table,", "walks.", "x1", "données", "\U0001f600", "blue", "stone", "carries", "light"]
    seps = [" ", " ", " ", " ", "\n", "  ", "\t", " \n", "\n\n", "\x0b", " "]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 150))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    line = "the river of stone and light walks to the blue table with you "
    rows: list[tuple] = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\r ", "en", "a", 6),
        (4, "one", None, "b", 3),
        (None, "a row without a number", "en", "b", 22),
        (5, "same text twice", "en", "c", 15),
        (5, "same text twice", "en", "c", 15),
        (6, "same text twice", "de", "c", 15),
        (7, line * 4000, "en", "a", None),
        (8, "x" * 300_000, "en", None, 300_000),
        (9, "1 " * 60_000, "fr", "a", 120_000),
        (10, "mail a@b.c_d@e.f and 1.2.3.4 or 300.1.1.1, +49 (30) 1234-5678, card 4111 1111 1111 1111", "en", "b", 88),
        (11, "9" * 50_000, "en", "b", 50_000),
        (-3, "a negative number 😀".encode("utf-16", "surrogatepass").decode("utf-16"), "en", "a", 19),
    ]
    rows += [(100 + k, t, "en", f"s{k % 5}", len(t)) for k, t in enumerate(random_texts(60, 11))]
    rows += [(200 + k, (line * 9 + f"ends {k % 3} here")[k % 2 :], "en", "near", 500) for k in range(12)]
    return rows


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(odd: DataFrame) -> DataFrame:
    """The same rows with columns whose names the operators use inside, of other types."""
    return odd.withColumns({c: F.lit("mine") for c in CLASSHING_LOWER})


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


CLASSHING_LOWER = [c for c in CLASHING if c not in SCHEMA]
