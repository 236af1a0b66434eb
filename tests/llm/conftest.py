"""Rows that every text operator has to take: nulls, empty, white and long texts, ties, repeated rows, and other columns."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [p for p in (ROOT, os.path.join(ROOT, "tests")) if p not in sys.path]

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, row string, name string, size string, score string, k string"
WORDS = [f"word{i}" for i in range(400)]


def odd_rows() -> list[tuple]:
    """(doc_id, text, source)"""
    base = " ".join(WORDS[:100])
    return [
        (1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (4, "one", "b"), (5, "One", "b"), (6, "one two three", None), (6, "one two three", None),
        (7, base, "a"), (8, base + " end", "a"), (9, base.replace(" ", "  "), "a"), (10, base.upper(), "c"), (None, "no id here", "c"), (None, None, None),
        (11, "é́ ß Σ ΑΣ 漢字 \x1cx\x85y\xa0z <|endoftext|> a<|endoftext|>b", "b"), (12, "x" * 200_000, "long"), (13, " ".join(WORDS * 60), "long"),
        (14, "  two  spaces  ", "b"), (15, base, "z"), (16, " ".join(WORDS[50:150]), "z"), (17, "a\x00b c", "b"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "xx", s, -1, "r", "r", "n", "s", "q", "k") for i, t, s in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are absent")
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
