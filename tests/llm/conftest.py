from __future__ import annotations

import pytest

#: Texts that every document operator must stand: nulls, nothing, blanks, long, repeated, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (7, "x" * 20_000),
    (8, "word " * 3_000), (9, "é ß 日本語 😀 ́ ▁  two  blanks　wide"), (10, "<s> </s> <|endoftext|> 'll it's"), (11, "The MIT License\nThe MIT License\n\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names the operators use themselves."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.selectExpr("doc_id", "text", "1 AS id", "'x' AS fp", "0 AS kept", "'k' AS keep_id", "2 AS spans", "'en' AS lang", "'s' AS source", "7L AS n_chars")


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
