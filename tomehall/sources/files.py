"""Corpus folders as DataFrames. Paths may be of any file system that Spark reads; ignore files count on this machine's own."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Document
from .ignored import special

FILES = "corpus_ord int, path string, content string"
LISTED = "corpus_ord int, doc_ord long, path string, title string, category string, tags array<string>"


def text_files(spark: SparkSession, roots: list[tuple[int, str]]) -> DataFrame:
    """corpus_ord, path (relative to its root), content of all text files below the roots.

    Manifests at any depth, names that start with a dot, files with a NUL byte and what `.ignore` files exclude (in a git repository also `.gitignore`) are left out.
    Names that start with `_`, which Spark's own listing skips, are read one by one. Bytes that aren't UTF-8 become U+FFFD; a search leaves their lines out."""
    out = None
    for ord_, root in roots:
        base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*").load(root)
        path = F.expr(f"substring(path, length('{base.replace(chr(39), chr(39) * 2)}') + 2)") if "'" not in base else F.substring(F.col("path"), len(base) + 2, 1 << 30)
        one = read.select(F.lit(ord_).alias("corpus_ord"), path.alias("path"), "content")
        local = root.removeprefix("file://")
        excluded, under = special(local) if "://" not in local else ([], [])
        if under:
            one = one.unionByName(opened(spark, ord_, local, under))
        if excluded:
            one = one.join(spark.createDataFrame([(p,) for p in excluded], "path string"), "path", "left_anti").select("corpus_ord", "path", "content")
        one = one.where(~F.col("path").rlike(r"(^|/)\.") & (F.substring_index("path", "/", -1) != "manifest.json"))
        one = one.where(F.instr(F.decode("content", "ISO-8859-1"), "\0") == 0)
        one = one.select("corpus_ord", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], FILES)


def opened(spark: SparkSession, ord_: int, root: str, paths: list[str]) -> DataFrame:
    """Files of this machine by their paths."""

    def run(batches):
        for b in batches:
            names = b.column("path").to_pylist()
            data = []
            for name in names:
                with open(os.path.join(root, name), "rb") as f:
                    data.append(f.read())
            yield pa.RecordBatch.from_arrays([pa.array([ord_] * len(names), pa.int32()), b.column("path"), pa.array(data, pa.binary())], names=["corpus_ord", "path", "content"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(run, "corpus_ord int, path string, content binary")


def manifest_rows(spark: SparkSession, manifests: list[tuple[int, list[Document]]]) -> DataFrame:
    rows = [(o, i, d.path, d.title, d.category, list(d.tags)) for o, docs in manifests for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, LISTED)


def listed_documents(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows with their readable contents; rows without one are left out."""
    readable = files.where(~F.contains("content", F.lit("�")))
    return manifest.join(readable, ["corpus_ord", "path"])


def missing_documents(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(files.where(~F.contains("content", F.lit("�"))), ["corpus_ord", "path"], "left_anti")
