"""Ranked search: a query tree scored by BM25 in one pass over the postings that it needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quantised_length, value, within
from ..plans.grammar import RAW_FIELDS, Leaf, Node, leaves
from .index import FIELDS, Index, bucket

K1, B = 1.2, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(weight: Column, tf: Column, length: Column, average: Column) -> Column:
    return weight * (K1 + 1) * tf / (tf + K1 * (1 - B + B * quantised_length(length) / average))


def only(index: Index, df: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of the terms; on a stored index their buckets alone are read."""
    out = df.where(F.col("term").isin(terms))
    if index.buckets:
        out = out.where(F.col("bucket").isin(sorted(set(value(F.array(*(bucket(F.lit(t), index.buckets) for t in terms)))))))
    return out


def weights(index: Index, leaf_terms: list[tuple[int, str, str]]) -> DataFrame:
    """corpus_ord, leaf, field, term, weight, average for the terms of a query: a few rows for each corpus."""
    spark = index.docs.sparkSession
    asked = spark.createDataFrame(leaf_terms, "leaf int, field string, term string")
    found = only(index, index.terms, sorted({t for _, _, t in leaf_terms})).join(F.broadcast(asked), ["field", "term"])
    sized = index.stats.select("corpus_ord", "field", "n_docs", (F.col("total") / F.col("n_docs")).alias("average"))
    return found.join(F.broadcast(sized), ["corpus_ord", "field"]).select("corpus_ord", "leaf", "field", "term", idf(F.col("n_docs"), F.col("df")).alias("weight"), "average")


def term_hits(index: Index, wanted: list[tuple[int, str, str]]) -> DataFrame:
    w = weights(index, wanted)
    post = only(index, index.postings, sorted({t for _, _, t in wanted}))
    hits = post.join(F.broadcast(w), ["corpus_ord", "field", "term"])
    return hits.select("corpus_ord", "doc_ord", "leaf", bm25(F.col("weight"), F.col("tf"), F.col("length"), F.col("average")).alias("s"))


def raw_hits(index: Index, leaf_no: int, leaf: Leaf) -> DataFrame:
    """An untokenised field: one term of length one in each document, so the score is its inverse frequency alone."""
    field = F.col(leaf.field)
    if leaf.kind == "term":
        sizes = index.docs.groupBy("corpus_ord").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(field == leaf.terms[0]).alias("df"))
        hits = index.docs.where(field == leaf.terms[0]).join(F.broadcast(sizes), "corpus_ord")
        return hits.select("corpus_ord", "doc_ord", F.lit(leaf_no).alias("leaf"), idf(F.col("n_docs"), F.col("df")).alias("s"))
    test = field.isin(list(leaf.terms)) if leaf.kind == "set" else in_range(field, leaf)
    return index.docs.where(test).select("corpus_ord", "doc_ord", F.lit(leaf_no).alias("leaf"), F.lit(1.0).alias("s"))


def in_range(c: Column, leaf: Leaf) -> Column:
    test = F.lit(True)
    if leaf.low is not None:
        test &= (c >= leaf.low) if leaf.closed[0] else (c > leaf.low)
    if leaf.high is not None:
        test &= (c <= leaf.high) if leaf.closed[1] else (c < leaf.high)
    return test


def among(index: Index, vocabulary: DataFrame, *columns: str) -> DataFrame:
    """Postings of some terms(corpus_ord, field, term) with further columns of theirs; on a stored index the buckets that those don't lie in are pruned as the plan runs."""
    keys = ["corpus_ord", "field", "term"] + (["bucket"] if index.buckets else [])
    return index.postings.join(vocabulary.select(*keys, *columns), keys)


def constant_hits(index: Index, leaf_no: int, leaf: Leaf) -> DataFrame:
    """Documents with a term of a set or a range, which is tested once for each term of the vocabulary; score 1."""
    named = F.col("field") == leaf.field
    if leaf.kind == "set":
        hits = only(index, index.postings.where(named), list(leaf.terms))
    else:
        hits = among(index, index.terms.where(named & in_range(F.col("term"), leaf)))
    return hits.select("corpus_ord", "doc_ord").distinct().select("corpus_ord", "doc_ord", F.lit(leaf_no).alias("leaf"), F.lit(1.0).alias("s"))


def phrase_hits(index: Index, leaf_no: int, leaf: Leaf) -> DataFrame:
    """Places of the first term that the others follow, each at most `slop` from its exact place; weights of all terms added."""
    stated = leaf.terms[:-1] if leaf.prefix else leaf.terms
    named = F.col("field") == leaf.field
    test = F.col("term").isin(list(stated)) if stated else F.lit(False)
    if leaf.prefix:
        test |= F.col("term").startswith(leaf.terms[-1])
    post = index.postings.where(named & test)
    if not leaf.prefix:
        post = only(index, post, list(stated))
    places = lambda i: F.flatten(F.transform(F.filter("found", lambda x: x["term"].startswith(leaf.terms[i]) if leaf.prefix and i == len(leaf.terms) - 1 else x["term"] == leaf.terms[i]), lambda x: x["positions"]))
    grouped = post.groupBy("corpus_ord", "doc_ord", "length").agg(F.collect_list(F.struct("term", "positions")).alias("found"))  # a row for each different term of the phrase at most
    grouped = grouped.select("corpus_ord", "doc_ord", "length", *(places(i).alias(f"p{i}") for i in range(len(leaf.terms))))

    def follows(p):
        at = lambda i: lambda q: F.abs(q - p - leaf.offsets[i]) <= leaf.slop
        tests = [F.exists(f"p{i}", at(i)) for i in range(1, len(leaf.terms))]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    counted = grouped.withColumn("tf", F.size(F.filter("p0", follows))).where("tf > 0")
    terms = index.terms.where(named & test) if leaf.prefix else only(index, index.terms.where(named), list(stated))
    sized = index.stats.where(named).select("corpus_ord", "n_docs", (F.col("total") / F.col("n_docs")).alias("average"))
    summed = terms.join(F.broadcast(sized), "corpus_ord").groupBy("corpus_ord", "average").agg(F.sum(idf(F.col("n_docs"), F.col("df"))).alias("weight"))
    hits = counted.join(F.broadcast(summed), "corpus_ord")
    return hits.select("corpus_ord", "doc_ord", F.lit(leaf_no).alias("leaf"), bm25(F.col("weight"), F.col("tf"), F.col("length"), F.col("average")).alias("s"))


def matched(node, number: dict) -> tuple[Column, Column]:
    """Whether a document matches, and its score, from columns m<leaf> and s<leaf>."""
    if isinstance(node, Leaf):
        return F.col(f"m{number[node]}"), F.col(f"s{number[node]}")
    parts = {name: [matched(c, number) for c in getattr(node, name)] for name in ("must", "should", "never")}
    if not node.must and not node.should:
        return F.lit(False), F.lit(0.0)  # only exclusions: nothing
    ok = reduce(lambda a, b: a & b, (m for m, _ in parts["must"]), F.lit(True))
    if not node.must:
        ok &= reduce(lambda a, b: a | b, (m for m, _ in parts["should"]))
    for m, _ in parts["never"]:
        ok &= ~m
    score = reduce(lambda a, b: a + b, (F.when(m, s).otherwise(0.0) for name in ("must", "should") for m, s in parts[name]))
    return ok, score * node.boost


def scored(index: Index, node: Node, category: str | None = None) -> DataFrame:
    """corpus_ord, doc_ord, score of the documents that match. With a category its inverse frequency is part of the score."""
    if category is not None:
        node = Node(must=(node, Leaf("term", "category", (category,))))
    number = {leaf: i for i, leaf in enumerate(leaves(node))}
    hits, terms = [], []
    for leaf, i in number.items():
        if leaf.kind == "all":
            hits.append(index.docs.select("corpus_ord", "doc_ord", F.lit(i).alias("leaf"), F.lit(1.0).alias("s")))
        elif leaf.field in RAW_FIELDS:
            hits.append(raw_hits(index, i, leaf))
        elif leaf.kind == "term":
            terms.append((i, leaf.field, leaf.terms[0]))
        elif leaf.kind == "phrase":
            hits.append(phrase_hits(index, i, leaf))
        else:
            hits.append(constant_hits(index, i, leaf))
    if terms:
        hits.append(term_hits(index, terms))
    if not hits:
        return index.docs.select("corpus_ord", "doc_ord", F.lit(0.0).alias("score")).where("false")
    every = reduce(lambda a, b: a.unionByName(b), hits)
    columns = [c for i in number.values() for c in (F.coalesce(F.bool_or(F.col("leaf") == i), F.lit(False)).alias(f"m{i}"), F.coalesce(F.sum(F.when(F.col("leaf") == i, F.col("s"))), F.lit(0.0)).alias(f"s{i}"))]
    ok, score = matched(node, number)
    return every.groupBy("corpus_ord", "doc_ord").agg(*columns).where(ok).select("corpus_ord", "doc_ord", score.alias("score"))


def fuzzy(index: Index, query: str, distance: int, category: str | None = None) -> DataFrame:
    """corpus_ord, doc_ord, score: one for each word and field with a term within the distance. Words are split at white space and left as they are."""
    # the vocabulary once for all words and fields, then postings of what is near
    sized = lambda w: F.abs(F.length("term") - len(w)) <= distance  # noqa: E731  no edit changes the length by more than one, and this costs less than a distance
    words = F.filter(F.array(*(F.when(sized(w) & within(w, F.col("term"), distance), F.lit(i)) for i, w in enumerate(query.split()))), lambda x: x.isNotNull())
    near = index.terms.withColumn("words", words).where(F.size("words") > 0)
    hits = among(index, near, "words").select("corpus_ord", "doc_ord", "field", F.explode("words").alias("word")).distinct()
    out = hits.groupBy("corpus_ord", "doc_ord").agg(F.sum(F.lit(1.0)).alias("score"))
    if category is not None:
        only_these = raw_hits(index, 0, Leaf("term", "category", (category,)))
        out = out.join(only_these.select("corpus_ord", "doc_ord", F.col("s").alias("c")), ["corpus_ord", "doc_ord"]).select("corpus_ord", "doc_ord", (F.col("score") + F.col("c")).alias("score"))
    return out


def rows(index: Index, scores: DataFrame, limit: int | None) -> DataFrame:
    """Hits with stored fields: of each corpus the best `limit`, ties by document order."""
    top = scores
    if limit is not None:
        # the best of all corpora are among the best of each; limits come before stored fields are fetched
        place = F.row_number().over(Window.partitionBy("corpus_ord").orderBy(F.desc("score"), "doc_ord"))
        top = scores.withColumn("place", place).where(F.col("place") <= limit).drop("place")
    return top.join(index.docs, ["corpus_ord", "doc_ord"]).select(
        "corpus_ord", "doc_ord", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("title", F.lit("Unknown")).alias("title"), "category",
        F.coalesce("title", F.lit("Unknown")).alias("matched_line"), F.lit(1).cast("long").alias("line_number"), "score",
    )
