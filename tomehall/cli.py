"""The command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import tools
from .commands import Engine
from .functions import validate
from .functions.render import document_text, hit_text
from .model import Backend, TomehallError


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tomehall").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tomehall", description="Search, list and keep text corpora.")
    sub = p.add_subparsers(dest="command")
    s = sub.add_parser("search", help="search all corpora")
    s.add_argument("query")
    s.add_argument("-l", "--limit", type=int, default=10)
    s.add_argument("-c", "--category")
    s.add_argument("-s", "--case-sensitive", action="store_true")
    s.add_argument("-b", "--backend", choices=[b.value for b in Backend], default="literal")
    s.add_argument("-f", "--fuzzy", type=int)
    s = sub.add_parser("list", help="list documents")
    s.add_argument("-c", "--category")
    s = sub.add_parser("add", help="add a document")
    s.add_argument("-t", "--title", required=True)
    s.add_argument("-C", "--category", required=True)
    s.add_argument("-T", "--tags")
    s.add_argument("-f", "--file")
    s = sub.add_parser("get", help="print a document")
    s.add_argument("path")
    sub.add_parser("index", help="index all corpora")
    sub.add_parser("serve", help="serve tools over standard input and output")
    return p


def shown_hits(hits: DataFrame) -> str:
    rows = [r[0] for r in hits.select(hit_text()).collect()]
    return "\n".join([*rows, f"{len(rows)} result(s) found\n"]) if rows else "No results found.\n"


def shown_list(documents: DataFrame) -> str:
    return "".join(r[0] for r in documents.select(document_text()).collect()) or "No documents found.\n"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command is None:
        p.print_help()
        return 0
    out = sys.stdout.write
    try:
        if a.command == "search":
            validate.fuzzy(a.fuzzy)
        if a.command == "add":
            if a.file:
                with open(a.file, encoding="utf-8", newline="") as f:
                    content = f.read()
            else:
                content = sys.stdin.read()
            if not content.strip():
                raise TomehallError("content can't be empty")
        engine = Engine(spark or session())
        if a.command == "search":
            out(shown_hits(engine.search(a.query, a.limit, a.category, a.case_sensitive, Backend(a.backend), a.fuzzy)))
        elif a.command == "list":
            out(shown_list(engine.list_documents(a.category)))
        elif a.command == "add":
            doc = engine.add(a.title, content, a.category, a.tags)
            out(f"Added: {doc.title}\nCategory: {doc.category}\nPath: {doc.path}\n")
        elif a.command == "get":
            out(engine.get(a.path))
        elif a.command == "index":
            done = engine.index_all(lambda root: out(f"Indexed {root}\n"))
            out(f"Indexed {done} corpora\n")
        elif a.command == "serve":
            tools.serve(engine)
    except (TomehallError, OSError, UnicodeDecodeError) as e:
        sys.stderr.write(f"Error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
