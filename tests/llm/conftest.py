import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, score string, "
          "size string, before string, id string, key string, content string, host string, label string, copy string")


def as_docs(spark, rows):
    """(doc_id, text, source) rows as documents, with extra columns whose names operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), *["x"] * 9, None) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(rng.choice(("", "A")) + f"w{rng.randrange(words):x}" + rng.choice(("", "", ".", ",")) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, equal texts under other ids, repeated ids and rows."""
    rng = random.Random(7)
    base = prose(rng, 120)
    long = prose(rng, 30_000, 5000)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, base, "a"), (5, base, None), (6, " ".join(near), "é"),
            (7, long, "b"), (8, long + " end", "b"), (9, "one", ""), (9, "two words", "b"), (10, base, "a"), (10, base, "a"),
            (None, "no id here at all", "b"), (None, None, None), (11, "日本語のテキスト" * 9, "b"), (12, "x" * 5000, "b")]
    return rows + [(100 + k, prose(rng, rng.randrange(1, 200)), rng.choice("abc")) for k in range(40)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return as_docs(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_docs(spark, [])
