from __future__ import annotations

import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, d long, th int, size long, _spans string, _kept int, v int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows; extra columns clash with the operators' own names."""

    def build(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, 2, 3, "y", 4, 5) for r in rows], SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def hard(make):
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters."""
    words = " ".join(f"word{k % 97} and{k}" for k in range(4000))
    rows = [
        (1, "One two three four five six seven eight nine ten. Mail a.b@c.de or +1 (555) 555-1234.", "en", "s1"),
        (2, "one two three four five six seven eight nine ten. mail a.b@c.de or +1 (555) 555-1234.", "en", "s1"),
        (3, None, None, None),
        (4, "", "en", None),
        (5, " \t\n ", None, "s2"),
        (6, words, "en", "s2"),
        (6, words, "en", "s2"),
        (7, words + " end", "en", "s1"),
        (None, "no id at all, but words enough for a few shingles here", "de", "s1"),
        (None, None, "de", None),
        (8, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich ▁ \x00 \U0001f600 é", "de", "ß"),
        (9007199254740993, "4111 1111 1111 1111 and 10.0.0.1 and 1.2.3.999", "fr", "s3"),
    ]
    return make(rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([])


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x or 0))


HARD_IDS = [1, 2, 3, 4, 5, 6, 6, 7, 8, 9007199254740993, None, None]
