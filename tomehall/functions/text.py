"""Text functions: as columns for plans, and on the driver where a single value is needed."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LONGEST_TOKEN = 40
WORD = r"[\p{IsAlphabetic}\p{N}]"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def parse_tags(c: Column) -> Column:
    """Comma-separated tags, trimmed, empty ones dropped; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ",", -1), trimmed), lambda x: x != "")


def slug(c: Column) -> Column:
    return F.array_join(F.filter(F.split(F.regexp_replace(F.lower(c), rf"[^{WORD[1:]}", "-"), "-", -1), lambda x: x != ""), "-")


def file_stem(c: Column) -> Column:
    """The last path segment without its last extension; a dot-file's name stays whole."""
    return F.regexp_extract(F.substring_index(c, "/", -1), r"^(.+?)(\.[^.]*)?$", 1)


def tokens(c: Column) -> Column:
    """Array of (pos, term): runs of letters and digits, lower-cased; long ones are dropped but keep their position."""
    found = F.regexp_extract_all(c, F.lit(f"{WORD}+"), F.lit(0))
    placed = F.transform(found, lambda x, i: F.struct(i.alias("pos"), x.alias("term")))
    kept = F.filter(placed, lambda x: F.octet_length(x["term"]) < LONGEST_TOKEN)
    return F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), F.lower(x["term"]).alias("term")))


def quantised_length(c: Column) -> Column:
    """A field length in steps that a byte can number: exact below 24, four significant bits beyond."""
    x = F.greatest(c - 24, F.lit(1)).cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(x)) - 3, F.lit(0)))
    return F.when(c < 24, c.cast("double")).otherwise(24 + F.floor((c - 24) / step) * step)


def within(word: str, c: Column, distance: int) -> Column:
    """Whether restricted Damerau-Levenshtein distance to `word` is at most `distance` (an adjacent swap costs one).

    Levenshtein distance decides without swaps; with one, the words split around it, at most `distance` places apart."""
    if distance < 0:
        return F.lit(False)
    ways = [F.levenshtein(F.lit(word), c) <= distance]
    if distance:
        for i in range(len(word) - 1):
            for shift in range(-(distance - 1), distance):
                at = i + shift
                if at < 0 or word[i] == word[i + 1]:
                    continue
                swap = F.substring(c, at + 1, 2) == word[i + 1] + word[i]
                for before in range(distance):
                    parts = within(word[:i], F.substring(c, 1, at), before) & within(word[i + 2 :], F.substr(c, F.lit(at + 3)), distance - 1 - before)
                    ways.append(swap & parts)
    return reduce(lambda a, b: a | b, ways)


# ---- on the driver


def value(c: Column):
    """A column of literals, worked out by the session: what plans give, whatever Python's own tables of characters hold."""
    return SparkSession.active().sql("SELECT 1").select(c.alias("x")).first()[0]


def parse_tag_list(text: str | None) -> list[str]:
    return [t for t in (p.strip() for p in (text or "").split(",")) if t]


def slugify(title: str) -> str:
    return value(slug(F.lit(title)))


@lru_cache(4096)
def token_list(text: str) -> tuple[tuple[int, str], ...]:
    """What tokens() gives."""
    return tuple((t["pos"], t["term"]) for t in value(tokens(F.lit(text))))


@lru_cache(4096)
def lowered(text: str) -> str:
    return value(F.lower(F.lit(text)))
