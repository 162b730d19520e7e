"""The two search backends of a corpus behind one protocol."""

from __future__ import annotations

import logging
import os
import shutil
import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import validate
from .model import IndexMissing, IndexMode, Manifest, ReadOnlyIndex, SearchOptions
from .operators.index import build, load, save
from .plans.search import DEFAULT_LIMIT, literal_plan, ranked_plan
from .sources.files import listed_documents, manifest_rows, missing_documents, text_files
from .store import INDEX, replace_file

log = logging.getLogger(__name__)


class SearchBackend(Protocol):
    def search(self, query: str, options: SearchOptions) -> DataFrame: ...

    def needs_indexing(self) -> bool: ...

    def index(self) -> None: ...


def under(root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), "path")


class LiteralBackend:
    """Lines of the corpus's files; nothing to index."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest, corpus_ord: int = 0):
        self.spark, self.root, self.manifest, self.corpus_ord = spark, root, manifest, corpus_ord

    def search(self, query: str, options: SearchOptions) -> DataFrame:
        if query:
            validate.literal_query(query)
        files = text_files(self.spark, [(self.corpus_ord, self.root)])
        listed = manifest_rows(self.spark, [(self.corpus_ord, self.manifest.documents)])
        out = literal_plan(files, listed, query, case_sensitive=options.case_sensitive, category=options.category, limit=options.limit, folding=True)
        out = out.withColumn("path", under(self.root)).orderBy("path", "line_number")
        return out if options.limit is None else out.limit(options.limit)

    def needs_indexing(self) -> bool:
        return False

    def index(self) -> None:
        pass


def index_exists(root: str) -> bool:
    return os.path.isdir(os.path.join(root, INDEX))


class RankedBackend:
    """BM25 over the corpus's index: a folder of snapshots and a pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest, mode: IndexMode, corpus_ord: int = 0):
        self.spark, self.root, self.manifest, self.mode, self.corpus_ord = spark, root, manifest, mode, corpus_ord
        self.folder = os.path.join(root, INDEX)
        if not index_exists(root):
            if mode is IndexMode.READ_ONLY:
                raise IndexMissing(f"{root} has no index; run the index command")
            os.makedirs(self.folder)

    @property
    def index_path(self) -> str:
        """The snapshot that the pointer names."""
        pointer = os.path.join(self.folder, "current")
        if not os.path.isfile(pointer):
            raise IndexMissing(f"{self.root} has no index; run the index command")
        with open(pointer, encoding="utf-8") as f:
            return os.path.join(self.folder, f.read().strip())

    def search(self, query: str, options: SearchOptions) -> DataFrame:
        found = ranked_plan(load(self.spark, self.index_path), query, options.fuzzy, options.category, DEFAULT_LIMIT if options.limit is None else options.limit)
        return found.withColumns({"corpus_ord": F.lit(self.corpus_ord), "path": under(self.root)})

    def needs_indexing(self) -> bool:
        return True

    def index(self) -> None:
        """A new snapshot of the whole corpus; the pointer changes when it is complete. The snapshot before stays for those that read it; older ones go."""
        if self.mode is IndexMode.READ_ONLY:
            raise ReadOnlyIndex(f"the index of {self.root} was opened to be read")
        files, rows = text_files(self.spark, [(0, self.root)]), manifest_rows(self.spark, [(0, self.manifest.documents)])
        for r in missing_documents(files, rows).select("path").toLocalIterator():
            log.warning("%s can't be read and isn't indexed", r["path"])
        name = f"v{uuid.uuid4().hex[:12]}"
        save(build(listed_documents(files, rows)), os.path.join(self.folder, name))
        pointer = os.path.join(self.folder, "current")
        last = os.path.basename(self.index_path) if os.path.isfile(pointer) else None
        old = [n for n in os.listdir(self.folder) if n.startswith("v") and n not in (name, last)]
        replace_file(pointer, name)
        for n in old:
            shutil.rmtree(os.path.join(self.folder, n), ignore_errors=True)
