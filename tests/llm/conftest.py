import os

import pytest

from churnlens.llm.queries import tokenizer_file

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def byte_bpe():
    return tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="session")
def piece_model():
    return tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(os.path.join(SMALL, "documents.parquet"))


ODD_DOCS = [(1, "One two three four, five."), (2, None), (3, ""), (4, " \t\n "), (5, "One two three four, five."),
            (5, "One two three four, five."), (None, "no id here"), (7, "x"), (8, "a  b \n\n c\u3000d é 日本 😀"),
            (9, "<|endoftext|> and <s> as text"), (10, "word " * 30_000), (11, "z" * 20_000), (12, "İß ½²\x00\x02 end")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with added ones."""
    rows = [(i, t, None if k == 2 else "ab"[k % 2], 1.5, "x", "y") for k, (i, t) in enumerate(ODD_DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, size string, "
                                       "lang_pred string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
