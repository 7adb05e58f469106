"""Helpers for small corpora."""

import random
from pathlib import Path

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = Path("/root/testdata")


def corpus(spark, rows):
    """documents from (doc_id, text) or (doc_id, text, lang, source) rows, over three partitions."""
    full = [(*r, *("en", "web")[len(r) - 2 :], len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(40_000)}" for _ in range(60_000))
    blob = "x" * 2_500_000
    rows = [
        (1, "alpha beta", "en", "a", 10),
        (1, "alpha beta", "en", "a", 10),
        (1, "another text", None, None, None),
        (2, None, None, None, None),
        (None, "alpha beta", "en", "b", 1),
        (None, None, None, None, None),
        (3, "", "fr", "", 0),
        (4, " \t\n ", "fr", "b", 3),
        (5, long, "de", "c", len(long)),
        (6, long, "de", "c", len(long)),
        (7, blob, "de", "c", len(blob)),
        (8, "été «…» 漢字 🙂", "fr", "a", 12),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("id", "key", "rows", "uid", "kept", "size", "target", "at", "fp", "low", "words", "label"):
        frame = frame.withColumn(name, frame["n_chars"] * 0 + 7)
    return frame
