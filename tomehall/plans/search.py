"""Search plans: routing of each corpus to a backend, and the merge of their hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index
from ..operators.literal import literal_search
from ..operators.ranked import fuzzy, rows, scored
from .grammar import parse

DEFAULT_LIMIT = 10
COLUMNS = ("corpus_ord", "place", "path", "title", "category", "matched_line", "line_number", "score")


def literal_plan(files: DataFrame, manifest: DataFrame, query: str, **options) -> DataFrame:
    return literal_search(files, manifest, query, **options).withColumn("place", F.lit(0).cast("long")).select(*COLUMNS)


def ranked_plan(index: Index, query: str, distance: int | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
    if not query.strip() or limit == 0:
        return rows(index, scored(index, parse("*")).where("false"), None).withColumnRenamed("doc_ord", "place").select(*COLUMNS)
    scores = scored(index, parse(query), category) if distance is None else fuzzy(index, query, distance, category)
    return rows(index, scores, limit).withColumnRenamed("doc_ord", "place").select(*COLUMNS)


def merged(parts: list[DataFrame], limit: int | None) -> DataFrame:
    """All hits, best scores first, those without a score last, then by corpus and place in it."""
    out = reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc_nulls_last("score"), "corpus_ord", "place", "path", "line_number")
    return out if limit is None else out.limit(limit)
