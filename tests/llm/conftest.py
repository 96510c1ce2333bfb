import pytest

from sealstone.llm import jaccard

jaccard.TASKS = 8  # four cores: fewer tasks for the same cells

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \n\t ", "xx", "b"),
    (5, "one", "en", "b"),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu.", "en", "a"),
    (6, "word " * 30000, "en", "a"),
    (7, "日本語 テキスト 😀 é " * 20, "ja", "é"),
    (8, "x" * 50000, None, "b"),
    (None, "a row without a number has words of its own to lose and ten more", "en", "a"),
]
#: Columns of names that the operators use themselves.
EXTRA = "key string, n long, size long, row long, taken long, node long, spans string, list int, v double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, an empty and a very long text, repeated rows, clashing names."""
    rows = [(*r, "k", 1, 2, 3, 4, 5, "s", 6, 7.0) for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {EXTRA}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
