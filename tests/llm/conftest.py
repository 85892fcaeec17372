from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, size long, h string, kept boolean, fp long, __row int"
LONG = " ".join(f"word{k % 977} and{k % 13}." for k in range(30_000))


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    """Nulls, blanks, a very long text, ties, repeated rows, and extra columns named like results."""
    clean = "the quick brown fox jumps over the lazy dog while nine other animals look on from the quiet side of a wide river bank"
    rows = [
        (1, clean, "en", "a"), (2, clean, "en", "a"), (2, clean, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \t\n", "fr", "b"),
        (None, clean + " x", "en", "a"), (None, None, None, None), (6, LONG, "en", "c"), (7, "one", "de", "c"), (8, "Ünï cödé 漢字 🙂 don't <|endoftext|>", "de", "\u00e9"), (9, clean.upper(), "en", "b"),
    ]
    return spark.createDataFrame([(i, t, lang, s, 7, 0.5, 3, 9, "h", True, 4, 5) for i, t, lang, s in rows], ODD_SCHEMA)


@pytest.fixture(scope="session")
def empty(odd: DataFrame) -> DataFrame:
    return odd.where("false")


@pytest.fixture(scope="session")
def odd_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (6, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")
