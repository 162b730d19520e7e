"""Files of a corpus on the driver's file system: manifest, documents, atomic writes."""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import re
import shutil
import tempfile
import uuid
from dataclasses import asdict
from typing import Protocol

from pyspark.sql import SparkSession

from .functions.validate import contained
from .model import Document, Manifest, ManifestInvalid, ManifestNotFound, NotFound

MANIFEST, INDEX = "manifest.json", ".index"


class Storage(Protocol):
    """Where a corpus keeps its manifest and documents."""

    root: str

    def read_manifest(self) -> Manifest: ...

    def write_manifest(self, manifest: Manifest) -> None: ...

    def read_document(self, path: str) -> str: ...

    def write_document(self, path: str, content: str) -> None: ...

    def exists(self, path: str) -> bool: ...


def checked(data, where: str) -> Manifest:
    """A manifest from parsed JSON: path, title and category are required strings; unknown keys are ignored."""

    def text(d, key):
        if not isinstance(d, dict) or not isinstance(d.get(key), str):
            raise ManifestInvalid(f"{where}: {key} must be a string")
        return d[key]

    def strings(x):
        if not isinstance(x, list) or not all(isinstance(t, str) for t in x):
            raise ManifestInvalid(f"{where}: tags must be a list of strings")
        return x

    version, listed = text(data, "version"), data.get("documents", [])
    if not isinstance(listed, list):
        raise ManifestInvalid(f"{where}: documents must be a list")
    return Manifest(version, [Document(text(d, "path"), text(d, "title"), text(d, "category"), strings(d.get("tags", []))) for d in listed])


def replace_file(path: str, content: str) -> None:
    """Writes beside the file, then takes its place."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".new-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(content)
        os.chmod(name, 0o644)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for tables that outlive executors; where it names none, the warehouse, or on a single machine a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tomehall-scratch"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tomehall-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when Python ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def end():
        with contextlib.suppress(Exception):  # the JVM may be gone
            remove(spark, path)

    atexit.register(end)
    return path


class LocalStorage:
    """A folder with manifest.json and text files."""

    def __init__(self, root: str):
        self.root = root

    def load_manifest(self) -> Manifest:
        """Strict: a missing manifest is an error."""
        path = os.path.join(self.root, MANIFEST)
        if not os.path.isfile(path):
            raise ManifestNotFound(f"no manifest at {path}")
        try:
            with open(path, encoding="utf-8") as f:
                return checked(json.load(f), path)
        except (OSError, UnicodeDecodeError, json.JSONDecodeError) as e:
            raise ManifestInvalid(f"{path}: {e}") from e

    def read_manifest(self) -> Manifest:
        """Lenient: a missing manifest is an empty one."""
        return self.load_manifest() if os.path.exists(os.path.join(self.root, MANIFEST)) else Manifest()

    def write_manifest(self, manifest: Manifest) -> None:
        replace_file(os.path.join(self.root, MANIFEST), json.dumps(asdict(manifest), indent=2, ensure_ascii=False))

    def read_document(self, path: str) -> str:
        full = os.path.join(self.root, path)
        if not os.path.isfile(full):
            raise NotFound(f"no document at {full}")
        try:
            with open(full, encoding="utf-8", newline="") as f:
                return f.read()
        except UnicodeDecodeError as e:
            raise NotFound(f"document {full} isn't UTF-8") from e

    def write_document(self, path: str, content: str) -> None:
        replace_file(contained(self.root, path), content)

    def exists(self, path: str) -> bool:
        return os.path.exists(os.path.join(self.root, path))
