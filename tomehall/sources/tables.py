"""The driver's test tables as corpora: a corpus for each of four languages and one for all others, sources as categories, labelled documents in the manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Corpora in order; documents of any other language, or none, are the one after these.
LANGUAGES = ("en", "fr", "de", "es")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_ord, lang, doc_ord, path, category, content of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    order = F.lit(len(LANGUAGES))
    for k, x in enumerate(LANGUAGES):
        order = F.when(F.col("lang") == x, k).otherwise(order)
    return docs.select(order.cast("int").alias("corpus_ord"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.col("doc_id").alias("doc_ord"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("source").alias("category"), F.col("text").alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed ones, with title and tags."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("doc_ord"), "quality", "toxic")
    found = files(spark, sf_dir).join(labels, "doc_ord")
    title = F.substring(trimmed(F.substring_index("content", "\n", 1)), 1, 60)
    tags = F.array("lang", F.concat(F.lit("quality-"), F.col("quality").cast("string")), F.concat(F.lit("toxic-"), F.col("toxic").cast("string")))
    return found.select("corpus_ord", "doc_ord", "path", title.alias("title"), "category", tags.alias("tags"), "content")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).drop("content")
