import random

import pytest
from pyspark.sql import functions as F

from episodica.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abdeiklmnorst") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(3)
    long_text = "\n".join(sentence(rng, 12) + "." for _ in range(800))
    base = sentence(rng, 120) + "."
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 3), (2, base, "en", "a", 3), (3, " ".join(near), "en", "b", 3), (4, None, "en", "b", 0), (5, "", None, "c", 0),
        (6, " \t\n\r\x0b\x0c ", "en", None, None), (7, "One two", "en", None, 7), (8, "one TWO", "en", "a", 7), (None, sentence(rng, 40), None, None, None),
        (None, None, None, None, None), (9, long_text, "de", "c", 1), (10, base, "en", "a", 3), (10, base, "en", "a", 3),
        (11, "Été ÄÖ ñandú — «quoted» 12,5 x y z w \x1cctl <|endoftext|> I'm don't", "fr", "d", 1), (12, base.upper(), "en", "d", 2),
    ]
    return rows + [(100 + i, sentence(rng, rng.randint(1, 90)), "en", rng.choice("abcd"), i) for i in range(60)]


@pytest.fixture(scope="session")
def messy(llm, messy_rows):
    """The rows with extra columns whose names operators use themselves."""
    d = llm.createDataFrame(messy_rows, SCHEMA)
    extra = ["id", "size", "n", "node", "tk", "d", "doc", "p", "item", "shard", "slot", "bytes", "rows", "comp", "lines", "at", "k", "bits", "copies", "rate", "pattern", "kept"]
    return d.withColumns({c: F.lit("x") for c in extra}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], SCHEMA)
