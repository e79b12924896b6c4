"""Fixtures of the edge tables, imported by the test modules of this folder."""

import os
import sys

import pytest

SMALL = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = "alpha beta gamma delta " * 4_000
#: texts with nulls, blanks, odd white space, a very long one and copies
TEXTS = [(1, "The old man went to the sea, again."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "The old man went to the sea, again."),
         (7, "x" * 30_000), (None, "no id here"), (8, "line one\nline two\nline three"), (8, "line one\nline two\nline three"),
         (9, "a  b\u2028c\u3000d <|endoftext|> e'll 12,5 \U0001F389\U0001F389"), (10, "|||"), (11, "UPPER CASE WORDS")]


@pytest.fixture(scope="session")
def texts(spark):
    """Edge rows with further columns whose names clash with helper and result columns."""
    rows = [(i, t, None if i == 1 else "en", "src", None, 1.5, 7, b"x", "h") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, "
                                       "predicted int, ids binary, hash string")


@pytest.fixture(scope="session")
def small_labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(None, 1, 1), (50, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
