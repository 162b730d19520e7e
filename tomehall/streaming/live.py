"""Literal search over arriving documents: the same plan on a streaming table, line by line, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.literal import matching_lines


def arriving(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """corpus_ord, path, content of text files as they come into a folder."""
    read = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).text(folder, wholetext=True)
    return read.select(F.lit(0).alias("corpus_ord"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def watch(documents: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Matching lines of a streaming table of documents."""
    return matching_lines(documents, query, case_sensitive)
