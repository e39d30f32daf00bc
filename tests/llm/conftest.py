import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `size` string, `class` string, `key` string, `row` string, h string"
WORDS = [f"{a}{b}" for a in ("re", "th", "an", "on", "is", "la", "mo", "ku") for b in ("n", "st", "er", "or", "ing", "al", "ed", "um", "ix", "os")]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make_docs():
    """Random prose with exact and near copies, nulls, empty, short and very long texts, repeated rows."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(words(rng, rng.randint(3, 40)) + "." for _ in range(rng.randint(1, 5)))))
    for i in range(60, 75):
        base = rows[rng.randint(0, 20)][1]
        rows.append((i, base if i % 3 == 0 else base.replace(" ", "  ", 1) if i % 3 == 1 else base + " " + words(rng, 2)))
    rows += [(75, None), (76, ""), (77, " \n\t "), (78, "one"), (79, "One"), (80, words(rng, 12_000)), (81, "a " * 3000), (82, "Ünïcödé ß 日本語 " * 9), (None, rows[0][1]), (None, "no id here at all, none"), (5, rows[5][1]), (75, None)]
    sources = ["b", "a", None, "c"]
    return [(d, t, ("en", "fr", None)[n % 3], sources[n % 4] if n % 3 else "hot", len(t or ""), "x", "y", "z", "w", "v") for n, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
