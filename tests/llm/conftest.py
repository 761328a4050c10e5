import random

import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, bucket int, role string, row int, copies string, host string, rep long, n_words double, size int"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(3)
    base = words(rng, 120)
    texts = [None, "", " \n\t ", "a", "a b", "A B", base, base, base.upper(), base + " tail end", words(rng, 30_000), "é ü 日本 🙂 " + base, "x\n\nx\n\nx", "1 2 3 ### $$$", words(rng, 60), "same same same same same " * 20, "  lead and trail  \t"]
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "s1", "s2")[i % 3], None, None, 1, "r", 2, "c", "h", 5, 1.0, 9) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "null id text of some words", None, None, *rows[0][4:]), (2**62, words(rng, 55), "en", "s1", *rows[0][4:])]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 1), (13, 0, 0), (None, 1, 0), (9, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
