"""Schemas, options and errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

DOCUMENT = "path string, title string, category string, tags array<string>"
HIT = "path string, title string, matched_line string, line_number long, score double"


class TomehallError(Exception):
    """Anything that a command reports to its caller."""


class ManifestNotFound(TomehallError):
    pass


class ManifestInvalid(TomehallError):
    pass


class NotFound(TomehallError):
    pass


class AlreadyExists(TomehallError):
    pass


class InvalidInput(TomehallError):
    pass


class IndexMissing(TomehallError):
    pass


class ReadOnlyIndex(TomehallError):
    pass


class QuerySyntax(TomehallError):
    pass


class Backend(Enum):
    LITERAL = "literal"
    RANKED = "ranked"
    AUTO = "auto"


class IndexMode(Enum):
    READ_WRITE = "rw"
    READ_ONLY = "ro"


@dataclass(frozen=True)
class SearchOptions:
    limit: int | None = None
    category: str | None = None
    case_sensitive: bool = False
    fuzzy: int | None = None


@dataclass
class Document:
    path: str
    title: str
    category: str
    tags: list[str] = field(default_factory=list)


@dataclass
class Manifest:
    version: str = "1"
    documents: list[Document] = field(default_factory=list)
