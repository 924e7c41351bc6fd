import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, _row string, n int, toxicity_score double"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    """Near copies, exact copies in another case, nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    out = []
    for i in range(120):
        out.append((i, words(rng, rng.randint(1, 90)), "en", f"s{rng.randint(0, 4)}"))
    base = words(rng, 60).split()
    for i in range(120, 150):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = "changed" + str(rng.randint(0, 99))
        out.append((i, " ".join(copy), "en", "s0"))
    out += [(200, "Same Text Here", "en", "s1"), (201, "same text here", "en", None), (202, "SAME TEXT HERE", None, "s1"), (203, "Été", "fr", "s1"), (204, "été", "fr", "s1")]
    out += [(210, None, "en", "s2"), (211, "", "en", "s2"), (212, " \n\t", "en", "s2"), (None, "a null id", "en", "s2"), (None, None, None, None), (213, "one", "en", ""), (214, words(rng, 30_000), "en", "s3")]
    out += [(220, "repeated row of six words here", "en", "s4")] * 3
    return [(*r, None if i % 3 else 7, "clash", None, "row", i, 0.5) for i, r in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def raw():
    return [(r[0], r[1], r[3]) for r in rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
