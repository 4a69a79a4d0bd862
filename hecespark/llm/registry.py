"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hecespark.llm import bpe, hamming, media, mixing, recompression, secrets, simhash, suffixes, toxicity, warc
from hecespark.runtime import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC files and read from them again."""
    files = warc.write(table(spark, sf_dir, "pages"), warc.folder(spark))
    page = F.regexp_extract("record_id", r"page:(-?\d+)\z", 1)
    return warc.read(spark, files).select(F.when(page != "", page.cast("long")).alias("page_id"), F.col("target_uri").alias("url"), F.decode("payload", "UTF-8").alias("html"), F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"), "http_status", "status")


WARC_SQL = """
SELECT page_id, url, html, octet_length(encode(html))::BIGINT AS n_bytes, sha1(html) AS sha1, 200 AS http_status, 'ok' AS status
FROM pages WHERE html IS NOT NULL
"""


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A progressive JPEG of each embedding, decoded."""
    return media.decode(media.thumbnails(table(spark, sf_dir, "embeddings")), keep=("vec_id",))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeated_spans(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_media": op2_media,
    "op3_secrets": op3_secrets,
    "op4_bpe": op4_bpe,
    "op5_top_k": op5_top_k,
    "op6_toxicity": op6_toxicity,
    "op7_recompression": op7_recompression,
    "op8_suffix_array": op8_suffix_array,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = {"op1_warc": WARC_SQL, "op5_top_k": hamming.SQL}
