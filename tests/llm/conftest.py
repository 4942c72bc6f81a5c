import random

import pytest

#: Texts that operators must not stumble over: null, empty, blank, long, repeated, odd.
ODD_TEXTS = [
    None, "", " ", "\n\n", "one", "one two", "a  b   c\t\td ", " lead", "trail ", "Ünï ΣΑΣ Å ́x", "日本語テキスト", "😀" * 50, "x" * 3000, "ab" * 400 + " " + "1" * 300,
    "the cat sat on the mat. " * 400, "<|endoftext|> and <s>", "it's we're they'll I'd", "▁under ▁ score", "\x1c\x85\xa0 odd　blanks",
]


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["the", "an", "er", "ti", "on", "re", "st"]) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): odd texts, ordinary ones, repeated rows and a null id."""
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)]
    rows += [(100 + k, words(k, 30 + 40 * k)) for k in range(12)]
    return [*rows, rows[-1], rows[3], (None, "a text without an id " + words(7, 60))]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same as documents, with columns whose names operators might use themselves."""
    more = [(i, t, "en", "src", 1, 5, 6, "z") for i, t in odd_rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, kind string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
