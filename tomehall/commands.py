"""The commands: search, list_documents, get, add, index_all."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import config as configuration
from .backends import LiteralBackend, RankedBackend, SearchBackend, index_exists
from .functions import validate
from .functions.text import parse_tag_list, slugify
from .model import HIT, AlreadyExists, Backend, Document, IndexMode, InvalidInput, Manifest, NotFound, SearchOptions, TomehallError
from .plans.search import DEFAULT_LIMIT, merged
from .sources.files import manifest_rows
from .store import LocalStorage

log = logging.getLogger(__name__)
SHOWN = ("path", "title", "matched_line", "line_number", "score")


class Engine:
    """Commands over the configured corpora."""

    def __init__(self, spark: SparkSession, config: configuration.Config | None = None):
        self.spark = spark
        self.config = config or configuration.load()

    def corpora(self):
        """Order, storage and strict manifest of each corpus that exists, or the error that it gave. Corpora lie on this machine's file system; a root elsewhere is an error, not a corpus that doesn't exist."""
        for i, root in enumerate(self.config.roots):
            if "://" in root:
                yield i, LocalStorage(root), Manifest(), InvalidInput("corpora of other file systems can't be opened; mount them")
            elif os.path.exists(root):
                storage = LocalStorage(root)
                try:
                    yield i, storage, storage.load_manifest(), None
                except TomehallError as e:
                    yield i, storage, Manifest(), e

    def backend(self, i: int, storage: LocalStorage, manifest: Manifest, backend: Backend) -> SearchBackend:
        """The backend of one corpus; with AUTO the ranked one where an index exists."""
        if backend is Backend.RANKED or backend is Backend.AUTO and index_exists(storage.root):
            return RankedBackend(self.spark, storage.root, manifest, IndexMode.READ_ONLY, i)
        return LiteralBackend(self.spark, storage.root, manifest, i)

    def search(self, query: str, limit: int | None = DEFAULT_LIMIT, category: str | None = None, case_sensitive: bool = False, backend: Backend = Backend.LITERAL, fuzzy: int | None = None) -> DataFrame:
        """path, title, matched_line, line_number, score. Fails only where nothing is found and a corpus failed."""
        options = SearchOptions(limit, category, case_sensitive, fuzzy)
        parts, errors = [], []
        for i, storage, manifest, error in self.corpora():
            try:
                if error:
                    raise error
                parts.append(self.backend(i, storage, manifest, backend).search(query, options))
            except TomehallError as e:
                log.warning("corpus %s: %s", storage.root, e)
                errors.append(f"{storage.root}: {e}")
        out = merged(parts, limit).select(*SHOWN) if parts else self.spark.createDataFrame([], HIT)
        if errors and not (parts and out.head(1)):
            raise TomehallError("Search failed: " + "; ".join(errors))
        return out

    def list_documents(self, category: str | None = None) -> DataFrame:
        """title, category, tags, path in the order of corpora and manifests."""
        found, errors = [], []
        for i, storage, manifest, error in self.corpora():
            if error:
                log.warning("corpus %s: %s", storage.root, error)
                errors.append(f"{storage.root}: {error}")
            found.append((i, [Document(os.path.join(storage.root, d.path), d.title, d.category, d.tags) for d in manifest.documents if category in (None, d.category)]))
        if errors and not any(docs for _, docs in found):
            raise TomehallError("List failed: " + "; ".join(errors))
        return manifest_rows(self.spark, found).orderBy("corpus_ord", "doc_ord").select("title", "category", "tags", "path")

    def get(self, path: str) -> str:
        if ".." in path:
            raise InvalidInput("path can't hold ..")
        for _, storage, manifest, _ in self.corpora():
            if any(d.path == path for d in manifest.documents):
                return storage.read_document(path)
        raise NotFound(f"no document {path!r}")

    def add(self, title: str, content: str, category: str, tags: list[str] | str | None = None) -> Document:
        """Writes the document, then the manifest, of the first configured corpus."""
        validate.title(title)
        validate.identifier(category, "category")
        tags = parse_tag_list(tags) if tags is None or isinstance(tags, str) else list(tags)
        for t in tags:
            validate.identifier(t, "tag")
        if not self.config.roots:
            raise InvalidInput("no corpus is configured")
        storage = LocalStorage(self.config.roots[0])
        manifest = storage.read_manifest()
        doc = Document(f"{category}/{slugify(title)}.md", title, category, tags)
        validate.contained(storage.root, doc.path)
        if storage.exists(doc.path):
            raise AlreadyExists(f"{doc.path} exists already")
        storage.write_document(doc.path, content)
        manifest.documents.append(doc)
        storage.write_manifest(manifest)
        return doc

    def index_all(self, told: Callable[[str], None] = lambda root: None) -> int:
        """How many corpora have been indexed; fails only where none was and one failed. `told` hears of each that is done."""
        done, errors = 0, []
        for _, storage, manifest, error in self.corpora():
            try:
                if error:
                    raise error
                RankedBackend(self.spark, storage.root, manifest, IndexMode.READ_WRITE).index()
                done += 1
                told(storage.root)
            except (TomehallError, OSError) as e:
                errors.append(f"{storage.root}: {e}")
        if errors and not done:
            raise TomehallError("Index failed: " + "; ".join(errors))
        for e in errors:
            log.warning("%s", e)
        return done
