"""Shown texts of rows, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hit_text(title: str = "title", path: str = "path", line: str = "matched_line", number: str = "line_number", score: str = "score") -> Column:
    """`title: path (line N) (score: x.xx)` and the line below; no score where there is none."""
    shown = F.coalesce(F.concat(F.lit(" (score: "), F.format_string("%.2f", F.col(score)), F.lit(")")), F.lit(""))
    shown = F.when(F.col(score).isNull(), F.lit("")).otherwise(shown)
    return F.concat(F.col(title), F.lit(": "), F.col(path), F.lit(" (line "), F.col(number).cast("string"), F.lit(")"), shown, F.lit("\n  "), F.col(line), F.lit("\n"))


def document_text(category: str = "category", title: str = "title", tags: str = "tags", path: str = "path") -> Column:
    """`category: title [tags]` and the path below; no brackets where there are no tags."""
    listed = F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, ", "), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.col(category), F.lit(": "), F.col(title), listed, F.lit("\n  "), F.col(path), F.lit("\n"))
