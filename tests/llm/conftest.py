import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids binary, n int, rep string, part string, queue double, _text string"


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), b"x", 1, "r", "p", 0.5, "other")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty and very long texts, a repeated row, an id with two texts, and further columns with the operators' own names."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    long = " ".join(r.choice(words) for _ in range(30_000))
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "One two, THREE! 日本語 <|endoftext|> <s> ﬁ"), row(5, long, None, None), row(6, "x" * 3_000 + "é" * 500, "de", "s2"),
            row(7, "a b c d e f", "en", None), row(7, "a b c d e f", "en", None), row(8, "A B c D e f"), row(9, "first text here"), row(9, "quite another text"),
            row(None, "a b c d e f"), row(None, None, None, None), row(10, " ".join(["the same line of words"] * 40)), row(11, "\u2581\u2581 spaces    here " + " " * 50)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -5")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (5, 1, 0), (5, 0, 0), (8, 7, 9)], "doc_id long, quality int, toxic int")
