import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

LONG = "word " * 3000 + "line\nline\n" * 50
#: Nulls in every column, empty and white-space texts, repeats, ties, one long text, special strings.
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "same text here", "en", "b"), (4, "same text here", "en", "b"),
    (5, "same text here", None, "b"), (None, "same text here", "en", None), (None, None, None, None), (6, LONG, "en", "a"), (7, "<|endoftext|> don't 日本語  x  y", "fr", None),
    (8, "123 !!!", "en", "c"), (9, "a\nb\n\n\na\nb", "de", "c"), (4, "other text, same id", "en", "b"),
]


@pytest.fixture()
def odd(spark):
    """Odd rows with further columns whose names clash with those that operators make."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    clash = ["id", "h", "fp", "size", "target", "score", "n_chunks", "own", "key", "_h", "bucket", "chunks", "block", "digest", "whole", "rank"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


@pytest.fixture()
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
