import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids binary, epochs string, target string, size string, kept string, file string"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, columns that clash with what operators make."""
    rnd = random.Random(5)
    words = ["the", "of", "risk", "été", "straße", "ÉCOLE", "a", "x1", "😀"]
    texts = ["", None, " ", "\n\n", "one", "One", "a b", "12345 67", " nbsp　wide", "a\x00b c", "<|endoftext|> <s>", "word " * 30_000, "\t▁▁mark ▁x", "token = 'abcdefghijklmnop'", "é combining"]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(40)]
    rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "", None]), None if t is None else len(t), b"x", "e", "t", "s", "k", "f") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (500, texts[20], None, None, None, None, None, None, None, None, None), (-7, texts[21], "en", "a", 1, None, None, None, None, None, None)]
    return [*rows, (None, "no id at all", "en", "a", 3, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
