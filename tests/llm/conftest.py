from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session", autouse=True)
def workers_see_the_package(spark):
    from nightspark.llm.catalog import visible

    visible(spark)


CLASH = ("doc", "th", "line", "body", "n", "name", "id", "key", "_doc", "_host", "group", "component", "bands", "length", "pair", "part")


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a documents table with more columns, some of whose names the operators use inside."""

    def make(rows):
        data = [(i, t, "en", None if k % 5 == 4 else "src", 7, *["x"] * len(CLASH)) for k, (i, t) in enumerate(rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, blank, tiny, very long and repeated texts; null and repeated ids."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    plain = " ".join(f"k{i}" for i in range(80))
    return [(None, plain), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, plain + " a"), (5, plain + " a"), (6, "one"), (7, "one two"),
            (8, "Ünï çødé 日本語 " * 30), (9, plain), (9, "another text of the same id " * 3), (None, None)]
