"""Checks of names, queries and paths."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import InvalidInput
from .text import trimmed, value

LONGEST_NAME, LONGEST_QUERY, FARTHEST = 200, 1000, 2


def is_identifier(c: Column) -> Column:
    return (F.octet_length(c) <= LONGEST_NAME) & c.rlike(r"\A[\p{IsAlphabetic}\p{N}][\p{IsAlphabetic}\p{N}_-]*\z")


def is_title(c: Column) -> Column:
    return F.octet_length(c).between(1, LONGEST_NAME)


def is_literal_query(c: Column) -> Column:
    return (F.octet_length(c) <= LONGEST_QUERY) & ~F.contains(c, F.lit("\0"))


def is_filled(c: Column) -> Column:
    return F.length(trimmed(c)) > 0


def is_inside(c: Column) -> Column:
    """A relative path without a step up; links are for contained() to follow."""
    return (c != "") & ~F.startswith(c, F.lit("/")) & ~F.array_contains(F.split(c, "/", -1), "..")


def identifier(name: str, what: str) -> None:
    if not name:
        raise InvalidInput(f"{what} can't be empty")
    if len(name.encode()) > LONGEST_NAME:
        raise InvalidInput(f"{what} is longer than {LONGEST_NAME} bytes")
    if not value(is_identifier(F.lit(name))):
        raise InvalidInput(f"{what} {name!r} must start with a letter or digit and hold letters, digits, hyphens and underscores only")


def title(text: str) -> None:
    if not text:
        raise InvalidInput("title can't be empty")
    if len(text.encode()) > LONGEST_NAME:
        raise InvalidInput(f"title is longer than {LONGEST_NAME} bytes")


def literal_query(query: str) -> None:
    if len(query.encode()) > LONGEST_QUERY:
        raise InvalidInput("Query too long")
    if "\0" in query:
        raise InvalidInput("Query has invalid characters")


def fuzzy(distance: int | None) -> None:
    if distance is not None and not 0 <= distance <= FARTHEST:
        raise InvalidInput(f"fuzzy distance must be 0 to {FARTHEST}")


def contained(root: str, relative: str) -> str:
    """The absolute path of a relative one that stays inside root, links followed."""
    if not relative or os.path.isabs(relative) or ".." in relative.split("/"):
        raise InvalidInput(f"path {relative!r} isn't a relative path within the corpus")
    if not os.path.isdir(root):
        raise InvalidInput(f"corpus {root} doesn't exist")
    base, path = os.path.realpath(root), os.path.join(root, relative)
    if os.path.commonpath([base, os.path.realpath(path)]) != base:
        raise InvalidInput(f"path {relative!r} leads out of the corpus")
    return path
