import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp int, tokens string, host string, `at` string, component_id string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd white space, markup and signs."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Ünder", "niño", "hello,", "x", "don't", "ROUND", "été"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = line(30_000)
    texts = [None, "", " ", "\n\t ", "one", "one two", "!!! ???", "12345", long, long, "x" * 5000, "ab" * 3000, line(40), line(40), "same text here", "same text here", "same text here",
             "İstanbul   nbsp em ZW​J", "日本語 の 文章", "a\x0bb\x0cc\rd", "<|endoftext|> in text", "rep rep rep rep rep rep rep rep rep", "𝒳 astral 😀😀", "é combining ́", "null\x00byte"]
    rows = [(i * 3, t, "en", "s", 1, "clash", 7, "t", "h", "a", "c") for i, t in enumerate(texts)]
    rows += [rows[14], rows[14], (None, "no id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (-5, "same text here", None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
