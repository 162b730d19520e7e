"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomehall.llm.common import Scratch, table
from tomehall.llm.decontamination import contaminated
from tomehall.llm.jaccard_join import link
from tomehall.llm.language_id import recognised, train
from tomehall.llm.packing import pack
from tomehall.llm.pii import mask

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language has a lower probability is of none.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised, whatever it is; those without a letter and those told apart with less than SURE go."""
    return recognised(docs, train(docs), SURE).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document of the smallest doc_id; of rows of one doc_id, one. Rows without a doc_id stay."""
    other = link(docs).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(other, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a passage with the benchmark. Rows without a doc_id stay."""
    hit = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; n_chars follows them."""
    return mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens; a row for each piece."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: Trained and numeric stages aren't SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
