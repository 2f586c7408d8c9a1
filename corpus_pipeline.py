"""A corpus from raw documents to packed sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry.llm.common import materialise, table
from wavequarry.llm.packing import pack_documents
from wavequarry.llm.pii import sanitise
from wavequarry.llm.quality import keep_good, train_quality
from wavequarry.llm.simhash import keep_one
from wavequarry.llm.suffix_dedup import PASSAGE, remove_repeats


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after the text has changed."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), n).otherwise(F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the trained classifier reject go.

    A null or empty text has too few words and goes. Equal texts are judged alike, repeated
    rows and null ids like others. An empty table gives none.
    """
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id.

    Null and wordless texts are one group; ties of one id go to the least content hash; of
    wholly equal rows one stays. An id stands before none. An empty table gives none.
    """
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes or more (about 50 words) that occur twice go, in every copy; every document stays.

    A null text stays null, a short one as it is; one that repeats as a whole becomes empty,
    repeated rows included. An empty table gives none.
    """
    return _recounted(remove_repeats(docs, PASSAGE))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced; every document stays.

    A text without either, null included, stays as it is. Equal texts are treated alike,
    repeated rows and null ids like others. An empty table gives none.
    """
    return _recounted(sanitise(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets.

    A null or empty text is the end id alone. Repeated rows and null ids are rows of their
    own; other columns are left out. An empty table gives none.
    """
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]

#: No stage but the base counts can be said in SQL; tests/llm/test_pipeline.py holds run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; extra columns pass through all stages but the last. Null, empty, repeated and tied rows fare as each stage says."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
