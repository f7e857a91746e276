import random

import pytest

WORDS = "alpha beta gamma delta epsilon river stone bridge window garden market letter number silver winter summer harbour engine signal pocket".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


#: Names that the operators use inside, as columns of the input.
CLASH = "_r _rank _lang _spans _id _variant _new _masked bucket stripe shard key place cell ids rank score stage n label part block bin_id"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal ids, and clashing columns."""
    long = prose(40_000, 3) + "é漢字 " + "x" * 5000
    rows = [
        (1, prose(80, 1), "en", "a", 7),
        (2, None, "en", None, None),
        (3, "", "en", "b", 0),
        (4, " \n\t ", None, "b", 4),
        (None, prose(80, 5), "en", "c", 5),
        (None, None, None, None, None),
        (5, prose(80, 1), "en", "a", 7),
        (6, long, "en", "a", len(long)),
        (7, prose(60, 7), "en", "a", 1),
        (7, prose(60, 7), "en", "a", 1),
        (8, prose(60, 8), "en", "a", 1),
        (8, prose(60, 9), "en", "a", 1),
        (9, "!!! ... ???", "en", "a", 11),
    ]
    extra = CLASH.split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([r + ("x",) * len(extra) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make
