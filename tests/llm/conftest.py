"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

LONG = "wordy " * 30_000 + "x" * 20_000


@pytest.fixture(scope="session")
def odd_rows():
    return [
        (1, "The cat sat on the mat.", "en"),
        (2, None, None),
        (3, "", "en"),
        (4, "   \n\t ", "de"),
        (5, "The cat sat on the mat.", "fr"),
        (5, "The cat sat on the mat.", "fr"),
        (6, LONG, "en"),
        (7, "日本語 のテキスト 😀 é\n\nÅngström ½", None),
        (8, "x", "en"),
        (None, "no id here", "en"),
        (9, "a <|endoftext|> b </turn> ### c", "en"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With columns whose names operators might want for themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string")
    for name in ("n", "uid", "key", "shard", "slot", "bucket", "score", "rank", "part", "hash", "s1", "record", "a.b", "_first_k", "_first_hash", "_first_row", "_there", "_rank", "_shard", "_slot", "k", "tie", "row", "c0", "first", "bucket", "label", "y"):
        df = df.withColumn(name, F.lit(0))
    return df.withColumn("map", F.create_map(F.lit("a"), F.coalesce("doc_id", F.lit(0)))).withColumn("_first_k", F.concat(F.lit("keep"), F.monotonically_increasing_id().cast("string")))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
