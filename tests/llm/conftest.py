"""Rows that all corpus operators are tested on: nulls, empty, long and repeated texts, ties, copies, and columns with clashing names."""

import os
import random
import sys

import pytest

from tallysheet.session import ship

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_texts import text_of  # noqa: E402

@pytest.fixture(scope="session")
def rows():
    r = random.Random(5)
    base = [text_of(r, n) for n in (3, 60, 80, 120, 200, 400)]
    near = [" ".join(w if r.random() > 0.02 else "edit" for w in base[4].split(" ")) for _ in range(12)]
    texts = [None, "", "   \n ", "one", "one two", "Straße 🙂 ½ x² \x1c a__b", "w " * 5000, base[1], base[1], *base, *near, base[2] + "\n" + base[5]]
    out = [(i, t, ["en", "de", "fr", None][i % 4], f"h{i % 3}", i) for i, t in enumerate(texts)]
    return [*out, out[7], (None, base[3], None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
