import pytest
from pyspark.sql import types as T

#: Nulls in every column, empty and blank texts, a very long one, ties and repeated rows.
LONG = " ".join(f"word{k % 997} text{k % 31}" for k in range(30_000)) + "."
PROSE = "The quick brown fox jumps over the lazy dog, and then it walks home along the river until night falls."
ODD = [
    (1, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 3),
    (6, LONG, "en", "b", 9),
    (7, PROSE.replace("home", "away"), "fr", "c", 5),
    (None, PROSE, "fr", "c", 5),
    (None, None, None, None, None),
    (8, "Été àé ﬁn — 'tis <|endoftext|> 12.5 don't | a", "fr", None, 1),
    (9, "one two three", "de", "c", 1),
    (10, "one two three", "de", "c", 1),
    (-5, "x" * 70_000, "de", "c", 1),
    (11, "\n".join(["Same line here.", "Other line there."] * 20), "de", "c", 1),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ["shard", "size", "n", "rep", "s", "score", "kept", "n_words", "ids", "key", "range", "rank", "media", "toxic", "h", "i", "block", "record_type", "label", "node", "copy", "words", "_x", "_row", "_copy", "_id", "_score", "_verdict", "row", "own", "text_hash", "c0", "c1", "verdict", "place", "cleaned"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
