"""The inverted index: postings, term statistics and field statistics as tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quantised_length, tokens

FIELDS = ("title", "content")
#: Bytes of text for each bucket of terms, the most buckets, and documents whose postings of one term a task writes at most.
BUCKET_BYTES, MOST_BUCKETS, SALTED = 16_000_000, 1024, 2_000_000
#: Tokens that are gathered at once, about.
GATHERED = 1_000_000
SCHEMAS = {
    "docs": "corpus_ord int, doc_ord long, path string, title string, category string, tags array<string>",
    "postings": "corpus_ord int, doc_ord long, field string, term string, length long, tf long, positions array<int>, bucket int",
    "terms": "corpus_ord int, field string, term string, df long, bucket int",
    "stats": "corpus_ord int, field string, n_docs long, total long",
    "meta": "buckets int",
}


@dataclass
class Index:
    """docs(corpus_ord, doc_ord, path, title, category, tags), postings(corpus_ord, field, term, doc_ord, tf, positions, length),
    terms(corpus_ord, field, term, df), stats(corpus_ord, field, n_docs, total). A stored one has postings and terms by bucket of the term."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    documents: DataFrame | None = None
    buckets: int | None = None


def bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.hash(c), F.lit(buckets))


def postings(documents: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """One row for each term of a field of a document; with `terms`, for these alone.

    Texts are cut into tokens once, by the session's expressions; a field's tokens are gathered by term within their rows, in Arrow, so nothing is shuffled. No test
    on tokens stands between, as Spark would work it out, and the tokens with it, on every document that is read and once for each mention."""
    spread = documents.select(F.col("corpus_ord").cast("int"), F.col("doc_ord").cast("long"), *(tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in FIELDS))
    wanted = lambda f: F.col(f) if terms is None else F.filter(f, lambda x: x["term"].isin(terms))
    listed = spread.select("corpus_ord", "doc_ord", *(c for f in FIELDS for c in (F.size(f).cast("long").alias(f"{f}_length"), wanted(f)["pos"].alias(f"{f}_pos"), wanted(f)["term"].alias(f"{f}_term"))))
    fields, at_once = FIELDS, GATHERED

    def gathered(batches):
        for batch in batches:
            for f in fields:
                every = batch.column(f"{f}_pos").value_lengths().to_numpy()
                piece = (np.cumsum(every, dtype=np.int64) - every) // at_once
                cut = [0, *np.flatnonzero(np.diff(piece)) + 1, len(every)]
                for begin, end in zip(cut[:-1], cut[1:], strict=True):
                    b = batch.slice(begin, end - begin)
                    place, size = b.column(f"{f}_pos").flatten().to_numpy(), every[begin:end]
                    if not len(place):
                        continue
                    coded = b.column(f"{f}_term").flatten().dictionary_encode()
                    code = coded.indices.to_numpy().astype(np.int64)
                    row = np.repeat(np.arange(len(size)), size)
                    name = row * len(coded.dictionary) + code
                    order = np.argsort(name, kind="stable")  # places of a term stay in order
                    first = np.flatnonzero(np.diff(name[order], prepend=-1))
                    ends = np.append(first, len(order)).astype(np.int32)
                    one, of = order[first], pa.array(row[order[first]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("corpus_ord").take(of), b.column("doc_ord").take(of), pa.array([f]).take(pa.array(np.zeros(len(one), np.int64))), coded.dictionary.take(pa.array(code[one])),
                            b.column(f"{f}_length").take(of), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order])),
                        ],
                        names=["corpus_ord", "doc_ord", "field", "term", "length", "tf", "positions"],
                    )

    return listed.mapInArrow(gathered, SCHEMAS["postings"].removesuffix(", bucket int"))


def build(documents: DataFrame, terms: list[str] | None = None) -> Index:
    """An index of documents(corpus_ord, doc_ord, path, title, category, tags, content), as plans; with `terms`, of these, with statistics of all."""
    post = postings(documents, terms)
    terms = post.groupBy("corpus_ord", "field", "term").agg(F.count(F.lit(1)).alias("df"))
    sizes = [documents.select("corpus_ord", F.lit(f).alias("field"), F.size(tokens(F.coalesce(F.col(f), F.lit("")))).cast("long").alias("length")) for f in FIELDS]
    stats = sizes[0].unionByName(sizes[1]).groupBy("corpus_ord", "field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("length").alias("total"))
    return Index(documents.select("corpus_ord", "doc_ord", "path", "title", "category", "tags"), post, terms, stats, documents)


def save(index: Index, path: str) -> None:
    """Writes the tables of an index that build() gave. Documents are cut into tokens once; statistics come from the written postings.

    Postings and terms lie by bucket of the term, so that a query reads its terms' buckets only. There are more buckets for more text, and a bucket is
    written by more tasks for more documents, so that no task writes a frequent term alone."""
    spark = index.docs.sparkSession
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    n, size = index.documents.agg(F.count(F.lit(1)), F.sum(F.octet_length("content"))).first()
    buckets = max(8, min(MOST_BUCKETS, -(-(size or 0) // BUCKET_BYTES)))
    salts = -(-max(1, n) // SALTED)
    placed = index.postings.withColumn("bucket", bucket(F.col("term"), buckets))
    # each bucket's salts have a task of their own: dealt by hash, several buckets would meet in one task and others would have nothing to do
    task = F.col("bucket") * salts + F.pmod(F.xxhash64("doc_ord"), F.lit(salts))
    salted = placed.repartitionById(buckets * salts, task.cast("int"))
    salted.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    post = spark.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings")
    terms = post.groupBy("corpus_ord", "field", "term", "bucket").agg(F.count(F.lit(1)).alias("df")).select("corpus_ord", "field", "term", "df", "bucket")
    terms.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    sizes = index.docs.groupBy("corpus_ord").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    totals = post.groupBy("corpus_ord", "field").agg(F.sum("tf").alias("total"))
    stats = sizes.join(totals, ["corpus_ord", "field"], "left").select("corpus_ord", "field", "n_docs", F.coalesce("total", F.lit(0)).alias("total"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    spark.createDataFrame([(buckets,)], SCHEMAS["meta"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    docs, post, terms, stats, meta = (spark.read.schema(s).parquet(f"{path}/{t}") for t, s in SCHEMAS.items())
    return Index(docs, post, terms, stats, buckets=meta.first()[0])
