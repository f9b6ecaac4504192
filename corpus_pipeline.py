"""A training corpus from raw documents, in four stages.

Each stage takes what the one before it kept.  The first three return rows of
``documents`` with all their columns, the last returns the packed pieces.

Defined cases, for all stages: an empty table gives an empty one (a model without
labels is one that scores every text alike); texts of any length count whole; a null
text counts as empty; columns beside the identifier and the text are carried as they
are, whatever their names, and play no part (but in ties, see the third stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from tillroll.llm import minhash, packing, quality, toxicity
from tillroll.llm.common import new_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    An empty text has the score of a text without known words; rows that repeat, or
    share an identifier (null or not), are scored each by itself; a score equal to
    the threshold is rejected.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_rows(docs, model, lambda score: score < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    An empty text is scored as one passage without words; rows that repeat, or share
    an identifier (null or not), are scored each by itself; a score equal to the
    threshold is kept.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_rows(docs, model, lambda score: score >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 5-word shingles with similarity 0.8 or more connect.

    The smallest identifier stays, a null one only where there is no other; of rows
    that share it the one whose text has the smallest hash, then the one whose columns
    have; of equal rows one stays.  Texts without words are linked with nothing, but
    rows that share identifier and text are one.
    """
    return minhash.drop_duplicates(docs, words=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    An empty text is one piece with the end token; rows that repeat have pieces of
    their own, under the same (or a null) identifier; of equally good places for a
    piece any may be taken.
    """
    return packing.pack_documents(docs, capacity=2048)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: No SQL expresses the trained stages; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
