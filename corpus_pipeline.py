"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Toxic documents go; one document of each near-duplicate group stays; secrets are masked; the sources are mixed to
tempered weights in blocks of equal length; the blocks are encoded. SQL can express neither the classifier nor the
later stages, so ORACLE_SQL is None and tests hold every stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hecespark.llm import bpe, mixing, secrets, simhash, toxicity
from hecespark.runtime import drop, scratch, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't find toxic; it is fitted on the labelled among those that come in. Null texts stay, repeated
    rows are judged alike, and columns of other names stay as they are. No documents: none."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id; all documents outside groups, with those of null ids or texts. Of
    equal rows of one id one stays. Columns of other names stay as they are."""
    return simhash.drop_near(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; null and empty texts, repeated rows and columns of other names stay as they are."""
    return secrets.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of all documents' tokens as new documents, drawn to the sources' tempered weights. Null and empty texts add nothing, repeated
    rows each count, a null source is one of its own; of columns of other names the blocks have nulls."""
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, n_tokens and lossless of each block; a null text has null tokens, an empty one none."""
    return bpe.encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes when the next has been written; the last one's when the session ends."""
    folder = scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            drop(spark, before)
        before = f"{folder}/{name}"
    return docs
