import numpy as np
import pytest

WORDS = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]


@pytest.fixture(scope="session")
def prose():
    """Random texts of a number of words, reproducible."""
    def make(seed, n):
        rng = np.random.default_rng(seed)
        return " ".join("".join(p) for p in rng.choice(WORDS, (n, 2)))
    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Rows of documents that must not break anything: nulls, empty and long texts, ties, repeats, a clash of columns."""
    long = "\n".join(prose(i, 400) for i in range(60))
    return [
        (0, None), (1, ""), (2, " \n\t \n"), (3, "ab"), (4, long), (5, prose(1, 80)), (6, prose(1, 80)), (None, prose(2, 60)),
        (7, "É x  y\n\nz\t"), (8, prose(3, 50) + "\n" + prose(4, 50)), (9, prose(3, 50) + "\nonly here, a line"),
        (10, prose(5, 70)), (10, prose(5, 70)), (11, "x" * 5000), (12, "one two one two one two one two " * 10),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd):
    """The odd rows, with columns named like those the operators make."""
    clash = "score string, n_lines string, n_dropped string, n_words string, n_removed string, `a.b` int, _drops int, _row int, _alone int"
    rows = [(i, t, "s", "l", "d", "w", "r", 1, 2, 3, 4) for i, t in odd]
    return spark.createDataFrame(rows, f"doc_id long, text string, {clash}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
