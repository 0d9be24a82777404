import pytest

ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 3), (4, "One", "xx", "", 3),
    (None, "no id but eight words are in this text", "en", "b", 1), (5, "twice " * 40, "en", "a", 1), (5, "twice " * 40, "en", "a", 1),
    (6, "é" * 5000, "fr", "b", 1), (7, "x" * 200_000, "en", "b", 1), (8, "word " * 30_000, "en", "c", 1), (9, "𝄞 ß ﬁ <|endoftext|> ▁", "de", None, 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and columns whose names clash with results."""
    from pyspark.sql import functions as F
    clash = ("size", "target", "kept", "n_words", "score", "spans", "found", "n_tokens", "piece", "rank", "base", "k", "key", "classes")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("own") for c in clash}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
