"""Literal search: lines that hold a fixed string, unranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_stem, trimmed

DEFAULT_CAP = 100


def holds(c: Column, query: str, case_sensitive: bool, folding: bool = False) -> Column:
    """The fixed-string test. folding: full Unicode case folding in place of the faster comparison of lower case."""
    if case_sensitive:
        return F.contains(c, F.lit(query))
    if folding:
        return c.rlike("(?iu)\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    return F.contains(F.lower(c), F.lower(F.lit(query)))


def matching_lines(files: DataFrame, query: str, case_sensitive: bool = False, cap: int | None = None, folding: bool = False) -> DataFrame:
    """Columns of files but content, with matched_line and line_number: at most `cap` matching lines of each file.

    A file is tested before its lines are looked at, and its lines are filtered and cut inside one expression, so
    nothing is shuffled. A query with a line feed can't occur in a line."""
    if not query or "\n" in query:
        return files.drop("content").withColumns({"matched_line": F.lit(None).cast("string"), "line_number": F.lit(None).cast("long")}).where("false")
    lines = F.transform(F.split("content", "\n", -1), lambda x, i: F.struct((i + 1).cast("long").alias("line_number"), x.alias("line")))
    hits = F.slice(F.filter(lines, lambda x: holds(x["line"], query, case_sensitive, folding) & ~F.contains(x["line"], F.lit("�"))), 1, DEFAULT_CAP if cap is None else max(cap, 1))
    found = files.where(holds(F.col("content"), query, case_sensitive, folding)).withColumn("hit", F.explode(hits)).drop("content")
    return found.withColumns({"matched_line": trimmed(F.col("hit.line")), "line_number": F.col("hit.line_number")}).drop("hit")


def last_wins(manifest: DataFrame) -> DataFrame:
    """One row for each path of a corpus: of duplicates the last."""
    return manifest.groupBy("corpus_ord", "path").agg(F.max_by(F.struct("title", "category", "tags"), "doc_ord").alias("d")).select("corpus_ord", "path", "d.*")


def literal_search(files: DataFrame, manifest: DataFrame, query: str, case_sensitive: bool = False, category: str | None = None, limit: int | None = None, folding: bool = False) -> DataFrame:
    """Hits (corpus_ord, path, title, category, matched_line, line_number, score) of files(corpus_ord, path, content).

    Files that manifest(corpus_ord, doc_ord, path, title, category, tags) doesn't list have their stem as title and category `unknown`."""
    hits = matching_lines(files.select("corpus_ord", "path", "content"), query, case_sensitive, limit, folding)
    known = last_wins(manifest)
    out = hits.join(known, ["corpus_ord", "path"], "left").select(
        "corpus_ord",
        "path",
        F.coalesce("title", file_stem(F.col("path")), F.lit("Unknown")).alias("title"),
        F.coalesce("category", F.lit("unknown")).alias("category"),
        "matched_line",
        "line_number",
        F.lit(None).cast("double").alias("score"),
    )
    return out.where(F.col("category") == category) if category is not None else out
