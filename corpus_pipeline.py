"""The training-data pipeline: each stage applies one operator to all that the stage before has kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read as the next
stage's documents. All but the last return the columns of ``documents``. A
null or empty text is rejected by the first stage, as it has no language.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitpath.llm import langid, mixing, nearcopies, pieces, pii
from hitpath.llm.common import written


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_rows(spark: SparkSession) -> None:
    """Whole texts go to Python 1,000 at a time, unless the session has a number of its own.

    Spark and Python each hold a batch, and Spark's 10,000 texts are tens of megabytes in each of them.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language; the others go."""
    few_rows(spark)
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a similarity of 0.8 or more.

    Fingerprints miss most pairs near 0.8, so they only give candidates, along
    with minimum hashes; what is linked is confirmed by the sets themselves.
    """
    few_rows(spark)
    return nearcopies.deduplicated(docs, words=5, radius=6, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document is a row for each time it is taken."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text in the mix, and the text they decode to."""
    few_rows(spark)
    return pieces.encode_texts(docs, path("piece_bpe_32k.model")).select("doc_id", "source", "ids", "decoded")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Neither the language model nor the fingerprints and tokens can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
