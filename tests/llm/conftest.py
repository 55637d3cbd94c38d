"""The package on the workers, and documents with every awkward case."""

import pytest

from fairgrid.session import ship_package

EXTRA = "digest string, link string, text_sha256 string, bands string, _bucket int, _row int, _n int, kept boolean, shard int, rep long, component string, length string, lang string, source string"
SCHEMA = f"doc_id long, text string, {EXTRA}"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(start: int, n: int) -> str:
    return " ".join(WORDS[(start + i * (i % 7 + 1)) % len(WORDS)] + str((start * 31 + i) % 97) for i in range(n))


AWKWARD = [
    (1, "The house is big and the garden is green", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "en"), (5, "12 34 !!", None), (6, "x", "en"),
    (7, sentence(3, 60), "en"), (8, sentence(3, 60), "fr"), (9, sentence(3, 59) + " changed", None), (10, "Das Haus ist groß und der Garten ist grün", "de"),
    (11, "a  b\n\n c <|endoftext|> é́ 日本 ▁ \U0001f600 \x00", None), (None, "no id at all", "en"), (None, None, None), (12, sentence(5, 30_000), "en"),
    (13, "tie tie tie tie tie tie tie", "en"), (14, "TIE tie\ttie tie tie tie tie", "en"), (14, "TIE tie\ttie tie tie tie tie", "en"), (-5, "", "de"),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def build(spark, rows):
    return spark.createDataFrame([(i, t, *(["x"] * 4), 1, 1, 1, True, 3, 4, "c", "l", lang, "s") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    return build(spark, AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return build(spark, [])


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
