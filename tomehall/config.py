"""The configuration file: which corpora there are."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import InvalidInput

ENV = "TOMEHALL_CONFIG"


def expand_tilde(path: str) -> str:
    """Only a leading `~/` is the home folder; a bare `~` stays."""
    return os.path.join(os.path.expanduser("~"), path[2:]) if path.startswith("~/") else path


def expanded(c: Column, home: str) -> Column:
    """expand_tilde of a column, for a given home folder."""
    return F.when(F.startswith(c, F.lit("~/")), F.concat(F.lit(home.rstrip("/") + "/"), F.substring(c, 3, 1 << 30))).otherwise(c)


def config_path() -> Path:
    if named := os.environ.get(ENV):
        return Path(named)
    return Path(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")) / "tomehall" / "config.toml"


@dataclass
class Config:
    paths: list[str] = field(default_factory=lambda: ["~/tomehall"])

    @property
    def roots(self) -> list[str]:
        return [expand_tilde(p) for p in self.paths]


def load(path: Path | None = None) -> Config:
    """The file's configuration, defaults without a file; a broken file is an error."""
    path = path or config_path()
    if not path.exists():
        return Config()
    try:
        with open(path, "rb") as f:
            data = tomllib.load(f)
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise InvalidInput(f"configuration {path} can't be read: {e}") from e
    paths = data.get("corpus", {}).get("paths", Config().paths)
    if not isinstance(paths, list) or not all(isinstance(p, str) for p in paths):
        raise InvalidInput(f"configuration {path}: corpus.paths must be a list of strings")
    return Config(paths)
