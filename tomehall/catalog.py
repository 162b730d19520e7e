"""Registered queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cli
from . import config as configuration
from .commands import Engine
from .functions.render import document_text, hit_text
from .functions.text import file_stem, parse_tags, quantised_length, slug, token_list, tokens, trimmed
from .functions.validate import is_filled, is_identifier, is_inside, is_literal_query, is_title
from .model import AlreadyExists, Backend, Document, Manifest
from .operators.index import Index, build, load, save
from .operators.literal import last_wins, literal_search
from .operators.ranked import fuzzy, scored
from .plans.grammar import named_terms, parse
from .plans.search import literal_plan, merged, ranked_plan
from .sources import tables
from .store import LocalStorage, scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FILES = """files AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS corpus_ord, doc_id AS doc_ord,
 source || '/' || doc_id || '.md' AS path, source AS category, text AS content, coalesce(lang, 'unknown') AS lang FROM documents),
listed AS (SELECT f.corpus_ord, f.doc_ord, f.path, substr(trim(split_part(f.content, chr(10), 1), ' ' || chr(9) || chr(13)), 1, 60) AS title, f.category, f.content,
 f.lang || ', quality-' || l.quality || ', toxic-' || l.toxic AS tags FROM files f JOIN labels l ON l.doc_id = f.doc_ord)"""

TOKENS = """words AS (SELECT corpus_ord, doc_ord, field, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (
 SELECT corpus_ord, doc_ord, 'title' AS field, regexp_extract_all(title, '[\\p{L}\\p{N}]+') AS w FROM listed UNION ALL
 SELECT corpus_ord, doc_ord, 'content', regexp_extract_all(content, '[\\p{L}\\p{N}]+') FROM listed)),
tok AS (SELECT corpus_ord, doc_ord, field, lower(word) AS term, pos FROM words WHERE strlen(word) < 40),
post AS (SELECT corpus_ord, doc_ord, field, term, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT corpus_ord, doc_ord, field, count(*) AS length FROM tok GROUP BY ALL),
terms AS (SELECT corpus_ord, field, term, count(*) AS df FROM post GROUP BY ALL),
stats AS (SELECT c.corpus_ord, f.field, c.n_docs, coalesce(t.total, 0) AS total, coalesce(t.total, 0) / c.n_docs AS average FROM
 (SELECT corpus_ord, count(*) AS n_docs FROM listed GROUP BY ALL) c CROSS JOIN (VALUES ('title'), ('content')) f(field)
 LEFT JOIN (SELECT corpus_ord, field, sum(length) AS total FROM lens GROUP BY ALL) t ON t.corpus_ord = c.corpus_ord AND t.field = f.field)"""

IDF = "ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
STEPPED = "(CASE WHEN length < 24 THEN length ELSE 24 + floor((length - 24) / pow(2, greatest(floor(log2(greatest(length - 24, 1))) - 3, 0))) * pow(2, greatest(floor(log2(greatest(length - 24, 1))) - 3, 0)) END)"
BM25 = f"w * 2.2::DOUBLE * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {STEPPED} / average))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- literal

LITERAL = """hits AS (SELECT corpus_ord, path, line, line_number FROM (SELECT *, row_number() OVER (PARTITION BY corpus_ord, path ORDER BY line_number) AS nth FROM (
 SELECT corpus_ord, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM files) WHERE {test}) WHERE nth <= {cap}),
found AS (SELECT h.corpus_ord, h.path, coalesce(l.title, split_part(split_part(h.path, '/', 2), '.', 1)) AS title, coalesce(l.category, 'unknown') AS category,
 trim(h.line, ' ' || chr(9) || chr(13)) AS matched_line, h.line_number FROM hits h LEFT JOIN listed l USING (corpus_ord, path))"""
SHOWN = ["path", "title", "category", "matched_line", "line_number"]


def literal_sql(test: str, cap: int = 100, rest: str = "") -> str:
    return f"WITH {FILES}, {LITERAL.format(test=test, cap=cap)} SELECT {', '.join(SHOWN)} FROM found {rest}"


def literal(spark, d, word, **options) -> DataFrame:
    return literal_search(tables.files(spark, d), tables.manifest(spark, d), word, **options)


ANY = "contains(lower(line), '{}')".format


@query(literal_sql(ANY("thing")))
def literal_ci(spark, d):
    return literal(spark, d, "THING").select(*SHOWN)


@query(literal_sql("contains(line, 'Thing')"))
def literal_cs(spark, d):
    return literal(spark, d, "Thing", case_sensitive=True).select(*SHOWN)


@query(literal_sql(ANY("thing"), rest="WHERE category = 'src3'"))
def literal_category(spark, d):
    return literal(spark, d, "thing", category="src3").select(*SHOWN)


@query(literal_sql(ANY("thing"), rest="WHERE category = 'unknown'"))
def literal_unknown_category(spark, d):
    return literal(spark, d, "thing", category="unknown").select(*SHOWN)


@query(literal_sql(ANY("the"), 3))
def literal_per_file_cap(spark, d):
    return literal(spark, d, "the", limit=3).select(*SHOWN)


@query(literal_sql(ANY("thing"), 10, "ORDER BY corpus_ord, path, line_number LIMIT 10"))
def literal_limit(spark, d):
    return merged([literal_plan(tables.files(spark, d), tables.manifest(spark, d), "thing", limit=10)], 10).select(*SHOWN)


@query(literal_sql("contains(line, '. T')"))
def literal_metachar(spark, d):
    return literal(spark, d, ". T", case_sensitive=True).select(*SHOWN)


@query(f"WITH {FILES}, {LITERAL.format(test=ANY('oning'), cap=100)} SELECT path, line_number, length(matched_line) AS size FROM found")
def literal_trimmed_line(spark, d):
    return literal(spark, d, "oning").select("path", "line_number", F.length("matched_line").cast("long").alias("size"))


@query(
    """WITH parts AS (SELECT 0 AS corpus_ord, 'pages/' || page_id AS path, html AS content FROM pages UNION ALL SELECT 1, 'conversations/' || conv_id || '-' || turn, text FROM conversations
 UNION ALL SELECT 2, 'benchmark/' || item_id, text FROM benchmark),
hits AS (SELECT corpus_ord, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM parts)
SELECT corpus_ord, path, trim(line, ' ' || chr(9) || chr(13)) AS matched_line, line_number FROM (SELECT *, row_number() OVER (PARTITION BY corpus_ord, path ORDER BY line_number) AS nth FROM hits WHERE contains(lower(line), 'tion')) WHERE nth <= 100"""
)
def literal_multi_corpus(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    parts = [
        read("pages").select(F.lit(0).alias("corpus_ord"), F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content")),
        read("conversations").select(F.lit(1).alias("corpus_ord"), F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content")),
        read("benchmark").select(F.lit(2).alias("corpus_ord"), F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), F.col("text").alias("content")),
    ]
    none = tables.manifest(spark, d).where("false")
    return merged([literal_plan(p, none, "tion") for p in parts], None).select("corpus_ord", "path", "matched_line", "line_number")


# ---- listing


def listing(spark, d) -> DataFrame:
    return tables.manifest(spark, d).select("corpus_ord", "doc_ord", "title", "category", F.array_join("tags", ", ").alias("tags"), "path")


@query(f"WITH {FILES} SELECT corpus_ord, doc_ord, title, category, tags, path FROM listed")
def list_all(spark, d):
    return listing(spark, d)


@query(f"WITH {FILES} SELECT corpus_ord, doc_ord, title, category, tags, path FROM listed WHERE category = 'src5'")
def list_category(spark, d):
    return listing(spark, d).where("category = 'src5'")


@query(f"WITH {FILES} SELECT doc_ord, category || ': ' || title || ' [' || tags || ']' || chr(10) || '  ' || path AS shown FROM listed")
def list_rendered(spark, d):
    return tables.manifest(spark, d).select("doc_ord", F.rtrim(document_text(), F.lit("\n")).alias("shown"))


@query(f"WITH {FILES} SELECT path, content FROM listed WHERE path = 'src1/1.md' ORDER BY corpus_ord, doc_ord LIMIT 1")
def get_document(spark, d):
    return tables.documents(spark, d).where("path = 'src1/1.md'").orderBy("corpus_ord", "doc_ord").limit(1).select("path", "content")


# ---- index

_indexes: dict[tuple[str, str], str] = {}


def stored(spark, d) -> Index:
    """The stored index of the listed documents, written at the first query of a session that reads it."""
    key = spark.sparkContext.applicationId, d
    if key not in _indexes:
        path = scratch(spark, "index")
        save(build(tables.documents(spark, d)), path)
        _indexes[key] = path
    return load(spark, _indexes[key])


@query(f"WITH {FILES}, {TOKENS} SELECT term, count(*) AS times FROM tok WHERE field = 'content' GROUP BY ALL")
def tokens_vocab(spark, d):
    return tables.documents(spark, d).select(F.explode(tokens(F.col("content"))).alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("times"))


@query(f"WITH {FILES}, {TOKENS} SELECT corpus_ord, doc_ord, field, term, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS places FROM tok GROUP BY ALL")
def index_postings(spark, d):
    return stored(spark, d).postings.select("corpus_ord", "doc_ord", "field", "term", "tf", F.array_join("positions", ",").alias("places"))


@query(f"WITH {FILES}, {TOKENS} SELECT * FROM terms")
def index_terms(spark, d):
    return stored(spark, d).terms.drop("bucket")


@query(f"WITH {FILES}, {TOKENS} SELECT corpus_ord, field, n_docs, total FROM stats")
def index_stats(spark, d):
    return stored(spark, d).stats


@query(f"WITH {FILES}, {TOKENS} SELECT DISTINCT length, CAST({STEPPED} AS DOUBLE) AS stepped FROM lens")
def fieldnorm(spark, d):
    return stored(spark, d).postings.select("length", quantised_length(F.col("length")).alias("stepped")).distinct()


# ---- ranked


def ranked(spark, d, text: str, category: str | None = None) -> DataFrame:
    found = scored(stored(spark, d), parse(text), category)
    return found.select("corpus_ord", "doc_ord", F.round("score", 6).alias("score"))


def term_leaf(n: int, field: str, term: str) -> str:
    return f"""SELECT p.corpus_ord, p.doc_ord, {n} AS leaf, (SELECT any_value(0)) + {BM25.replace('w *', IDF + ' *', 1)} AS s FROM post p JOIN lens USING (corpus_ord, doc_ord, field) JOIN terms USING (corpus_ord, field, term)
 JOIN stats USING (corpus_ord, field) WHERE field = '{field}' AND term = '{term}'""".replace("(SELECT any_value(0)) + ", "")


def both(n: int, term: str) -> list[str]:
    return [term_leaf(n, f, term) for f in ("title", "content")]


def phrase_leaf(n: int, field: str, terms: list[str], near: str, last: str | None = None) -> str:
    """near: conditions on the aliases t0, t1 ... of tokens."""
    test = [f"t{i}.term = '{t}'" for i, t in enumerate(terms)] + ([f"starts_with(t{len(terms)}.term, '{last}')"] if last else [])
    joins = " ".join(f"JOIN tok t{i} ON t{i}.corpus_ord = t0.corpus_ord AND t{i}.doc_ord = t0.doc_ord AND t{i}.field = t0.field" for i in range(1, len(test)))
    names = " OR ".join([f"term = '{t}'" for t in terms] + ([f"starts_with(term, '{last}')"] if last else []))
    return f"""SELECT corpus_ord, doc_ord, {n} AS leaf, {BM25} AS s FROM (SELECT t0.corpus_ord, t0.doc_ord, count(DISTINCT t0.pos) AS tf FROM tok t0 {joins} WHERE t0.field = '{field}' AND {' AND '.join(test)} AND {near} GROUP BY ALL)
 JOIN (SELECT corpus_ord, doc_ord, length FROM lens WHERE field = '{field}') USING (corpus_ord, doc_ord)
 JOIN (SELECT corpus_ord, average, sum({IDF}) AS w FROM terms JOIN stats USING (corpus_ord, field) WHERE field = '{field}' AND ({names}) GROUP BY ALL) USING (corpus_ord)"""


CATEGORY_IDF = f"(SELECT corpus_ord, {IDF} AS c FROM (SELECT corpus_ord, count(*) AS n_docs, count(*) FILTER (category = '{{0}}') AS df FROM listed GROUP BY ALL))"


def ranked_sql(leaves: list[str], match: str, score: str = "sum(s)", docs: str = "") -> str:
    return f"WITH {FILES}, {TOKENS}, leaves AS ({' UNION ALL '.join(leaves)}) SELECT corpus_ord, doc_ord, round({score}, 6) AS score FROM leaves {docs} GROUP BY corpus_ord, doc_ord HAVING {match}"


HAS = "bool_or(leaf = {})".format
KEPT = "sum(s) FILTER (leaf <> {})".format


@query(ranked_sql([term_leaf(0, "content", "thing"), term_leaf(0, "title", "thing")], "true"))
def bm25_term(spark, d):
    return ranked(spark, d, "Thing")


@query(ranked_sql(both(0, "oning") + both(1, "ertion") + both(2, "erble"), "true"))
def bm25_or(spark, d):
    return ranked(spark, d, "oning ertion OR erble")


@query(ranked_sql([term_leaf(0, "title", "the"), term_leaf(1, "content", "ertion")], "true"))
def bm25_two_fields(spark, d):
    return ranked(spark, d, "title:the content:ertion")


@query(ranked_sql(both(0, "of") + both(1, "the"), f"{HAS(0)} AND {HAS(1)}"))
def bm25_and(spark, d):
    return ranked(spark, d, "of AND the")


@query(ranked_sql(both(0, "ertion") + both(1, "the"), f"{HAS(0)} AND NOT {HAS(1)}", KEPT(1)))
def bm25_not(spark, d):
    return ranked(spark, d, "ertion AND NOT the")


@query(ranked_sql(both(0, "ertion") + both(1, "oning") + both(2, "erble"), f"{HAS(0)} AND NOT {HAS(1)}", KEPT(1)))
def bm25_plus_minus(spark, d):
    return ranked(spark, d, "+ertion -oning erble")


@query(ranked_sql([phrase_leaf(0, f, ["of", "the"], "t1.pos = t0.pos + 1") for f in ("title", "content")], "true"))
def bm25_phrase(spark, d):
    return ranked(spark, d, '"of the"')


@query(ranked_sql([phrase_leaf(0, "content", ["of", "the"], "abs(t1.pos - t0.pos - 1) <= 2")], "true"))
def bm25_slop(spark, d):
    return ranked(spark, d, 'content:"of the"~2')


@query(ranked_sql([phrase_leaf(0, "content", ["of"], "t1.pos = t0.pos + 1", "th")], "true"))
def bm25_phrase_prefix(spark, d):
    return ranked(spark, d, 'content:"of th"*')


@query(ranked_sql([term_leaf(0, "title", "the")], "true"))
def bm25_field(spark, d):
    return ranked(spark, d, "title:the")


@query(ranked_sql(both(0, "ertion") + both(1, "oning"), "true", "sum(CASE WHEN leaf = 0 THEN 2.5::DOUBLE * s ELSE s END)"))
def bm25_boost(spark, d):
    return ranked(spark, d, "ertion^2.5 oning")


@query(f"WITH {FILES}, {TOKENS} SELECT DISTINCT corpus_ord, doc_ord, 1.0::DOUBLE AS score FROM post WHERE field = 'content' AND term >= 'oninga' AND term < 'oningz'")
def bm25_range(spark, d):
    return ranked(spark, d, "content:[oninga TO oningz}")


@query(f"WITH {FILES}, {TOKENS} SELECT DISTINCT corpus_ord, doc_ord, 1.0::DOUBLE AS score FROM post WHERE field = 'content' AND term IN ('ertion', 'oning')")
def bm25_in(spark, d):
    return ranked(spark, d, "content: IN [ertion oning]")


@query(f"WITH {FILES} SELECT corpus_ord, doc_ord, 1.0::DOUBLE AS score FROM listed")
def bm25_all(spark, d):
    return ranked(spark, d, "*")


@query(ranked_sql(both(0, "the"), "true", "sum(s) + any_value(c)", f"JOIN {CATEGORY_IDF.format('src4')} USING (corpus_ord) JOIN (SELECT corpus_ord, doc_ord FROM listed WHERE category = 'src4') USING (corpus_ord, doc_ord)"))
def bm25_category(spark, d):
    return ranked(spark, d, "the", "src4")


@query(f"SELECT path, score FROM ({ranked_sql(both(0, 'de') + both(1, 'in'), 'true')}) JOIN (SELECT doc_id AS doc_ord, source || '/' || doc_id || '.md' AS path FROM documents) USING (doc_ord) ORDER BY score DESC, corpus_ord, doc_ord LIMIT 10")
def bm25_multi_corpus_topk(spark, d):
    return merged([ranked_plan(stored(spark, d), "de in", limit=10).withColumn("score", F.round("score", 6))], 10).select("path", "score")


# ---- fuzzy


def near(spark, d, text: str, distance: int, category: str | None = None) -> DataFrame:
    return fuzzy(stored(spark, d), text, distance, category).select("corpus_ord", "doc_ord", F.round("score", 6).alias("score"))


def fuzzy_sql(test: str, score: str = "sum(s)", docs: str = "") -> str:
    return f"WITH {FILES}, {TOKENS}, hits AS (SELECT DISTINCT corpus_ord, doc_ord, field, 1.0::DOUBLE AS s FROM post WHERE {test}) SELECT corpus_ord, doc_ord, {score} AS score FROM hits {docs} GROUP BY corpus_ord, doc_ord"


#: On ASCII terms, where DuckDB's distances by bytes are distances by characters; no swap is worth more than one edit there.
ASCII = "regexp_full_match(term, '[ -~]*')"


@query(fuzzy_sql("term = 'thing'"))
def fuzzy_0(spark, d):
    return near(spark, d, "thing", 0)


@query(fuzzy_sql(f"{ASCII} AND damerau_levenshtein(term, 'thnig') <= 1 OR NOT {ASCII} AND length(term) BETWEEN 4 AND 6 AND levenshtein(regexp_replace(term, '[^ -~]', '?', 'g'), 'thnig') <= 1"))
def fuzzy_1(spark, d):
    return near(spark, d, "thnig", 1)


# restricted distance 2 to an eight-letter word: two plain edits, a swap and an edit, or two swaps, as levenshtein distances of rewritten words
@query(fuzzy_sql("regexp_replace(term, '[^ -~]', '?', 'g') IN (SELECT t FROM (SELECT DISTINCT regexp_replace(term, '[^ -~]', '?', 'g') AS t FROM post) WHERE levenshtein(t, 'oning') <= 2 OR " + " OR ".join(f"(damerau_levenshtein(t, 'oning') <= 2 AND levenshtein(t, '{w}') <= 1)" for w in ("noing", "oinng", "onnig", "onign"))  + ")"))
def fuzzy_2(spark, d):
    return near(spark, d, "oning", 2)


@query(fuzzy_sql(f"{ASCII} AND damerau_levenshtein(term, 'thnig') <= 1 OR NOT {ASCII} AND length(term) BETWEEN 4 AND 6 AND levenshtein(regexp_replace(term, '[^ -~]', '?', 'g'), 'thnig') <= 1", "round(sum(s) + any_value(c), 6)", f"JOIN {CATEGORY_IDF.format('src2')} USING (corpus_ord) JOIN (SELECT corpus_ord, doc_ord FROM listed WHERE category = 'src2') USING (corpus_ord, doc_ord)"))
def fuzzy_category(spark, d):
    return near(spark, d, "thnig", 1, "src2")


# ---- routing, functions, adding


@query(
    f"""WITH {FILES}, {TOKENS}, {LITERAL.format(test=ANY('ertion'), cap=20)}, leaves AS ({' UNION ALL '.join(both(0, 'ertion'))}),
best AS (SELECT corpus_ord, doc_ord AS place, path, round(sum(s), 6) AS score, 1 AS line_number FROM leaves JOIN listed USING (corpus_ord, doc_ord) WHERE corpus_ord = 0 GROUP BY ALL),
mixed AS (SELECT * FROM best UNION ALL SELECT corpus_ord, 0, path, NULL, line_number FROM found WHERE corpus_ord > 0)
SELECT corpus_ord, path, line_number, score FROM mixed ORDER BY score DESC NULLS LAST, corpus_ord, place, path, line_number LIMIT 20"""
)
def auto_mixed(spark, d):
    """The first corpus has an index, the others don't."""
    files, docs = tables.files(spark, d), tables.documents(spark, d)
    tree = parse("ertion")
    parts = [ranked_plan(build(docs.where("corpus_ord = 0"), named_terms(tree)), "ertion", limit=20).withColumn("score", F.round("score", 6)), literal_plan(files.where("corpus_ord > 0"), docs.drop("content"), "ertion", limit=20)]
    return merged(parts, 20).select("corpus_ord", "path", "line_number", "score")


@query(f"WITH {FILES} SELECT doc_ord, array_to_string(list_filter(string_split(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '-'), lambda x: x <> ''), '-') AS slug FROM listed")
def slugify(spark, d):
    return tables.manifest(spark, d).select("doc_ord", slug(F.col("title")).alias("slug"))


@query(f"WITH {FILES} SELECT doc_ord, array_to_string(list_filter(list_transform(string_split(' ' || tags || ' ,, x y ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM listed")
def parse_tags_query(spark, d):
    text = F.concat(F.lit(" "), F.array_join("tags", ", "), F.lit(" ,, x y "))
    return tables.manifest(spark, d).select("doc_ord", F.array_join(parse_tags(text), "|").alias("tags"))


@query("SELECT doc_id, strlen(w) BETWEEN 1 AND 200 AND regexp_full_match(w, '[\\p{L}\\p{N}][\\p{L}\\p{N}_-]*') AS valid FROM (SELECT doc_id, split_part(text, ' ', 1) AS w FROM documents)")
def valid_identifier(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", is_identifier(F.substring_index("text", " ", 1)).alias("valid"))


@query("SELECT page_id, regexp_extract(split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1), '^(.+?)(\\.[^.]*)?$', 1) AS stem FROM pages")
def file_stem_query(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", file_stem(F.substring_index(F.substring_index("url", "?", 1), "#", 1)).alias("stem"))


@query(
    f"""WITH {FILES}, new AS (SELECT 'benchmark/' || array_to_string(list_filter(string_split(regexp_replace(lower(substr(text, 1, 20)), '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '-'), lambda x: x <> ''), '-') || '.md' AS path FROM benchmark)
SELECT path, 'old' AS origin FROM listed WHERE corpus_ord = 0 UNION ALL SELECT path, 'new' FROM new WHERE path NOT IN (SELECT path FROM files)"""
)
def add_preview(spark, d):
    """The first corpus's manifest with the benchmark's items added, but for those whose file exists."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("benchmark/"), slug(F.substring("text", 1, 20)), F.lit(".md")).alias("path"))
    old = tables.manifest(spark, d).where("corpus_ord = 0").select("path", F.lit("old").alias("origin"))
    return old.unionByName(items.join(tables.files(spark, d).select("path"), "path", "left_anti").select("path", F.lit("new").alias("origin")))


@query("SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def index_missing_files(spark, d):
    """Listed documents without a readable file; here, short files count as unreadable."""
    files = spark.read.parquet(f"{d}/documents.parquet").where("n_chars > 500").select("doc_id")
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id").join(files, "doc_id", "left_anti")


@query(f"WITH {FILES}, twice AS (SELECT corpus_ord, doc_ord, category AS path, title FROM listed) SELECT corpus_ord, path, arg_max(title, doc_ord) AS title FROM twice GROUP BY ALL")
def manifest_last_wins(spark, d):
    """Categories stand for paths that a manifest lists many times."""
    return last_wins(tables.manifest(spark, d).withColumn("path", F.col("category"))).select("corpus_ord", "path", "title")


# ---- further forms of literal and ranked queries


@query(literal_sql("regexp_matches(line, '(?i)sin')"))
def literal_folding(spark, d):
    """Full case folding: a long s is an s."""
    return literal(spark, d, "SIN", folding=True).select(*SHOWN)


MARKED = FILES.replace("text AS content", "replace(text, 'tion ', chr(65533) || 'tion ') AS content")


@query(literal_sql("contains(lower(line), 'th') AND NOT contains(line, chr(65533))").replace(FILES, MARKED))
def literal_broken_bytes(spark, d):
    """Lines that aren't UTF-8 are left out, the others of their file aren't."""
    files = tables.files(spark, d)
    marked = F.replace("content", F.lit("tion "), F.lit("\ufffdtion "))
    raw = F.unhex(F.replace(F.hex(F.encode(marked, "utf-8")), F.lit("EFBFBD"), F.lit("FF")))
    title = F.substring(trimmed(F.substring_index(marked, "\n", 1)), 1, 60).alias("title")
    docs = tables.manifest(spark, d).drop("title").join(files.select("doc_ord", title), "doc_ord")
    return literal_search(files.withColumn("content", F.make_valid_utf8(raw.cast("string"))), docs, "TH").select(*SHOWN)


@query(literal_sql("false"))
def literal_empty_query(spark, d):
    return literal(spark, d, "").select(*SHOWN)


@query(ranked_sql(both(0, "ertion") + both(1, "oning") + both(2, "the"), f"({HAS(0)} OR {HAS(1)}) AND {HAS(2)}"))
def bm25_parentheses(spark, d):
    return ranked(spark, d, "(ertion OR oning) AND the")


@query(ranked_sql(both(0, "the"), "false"))
def bm25_only_negative(spark, d):
    return ranked(spark, d, "-the")


@query(f"WITH {FILES}, {TOKENS}, leaves AS ({' UNION ALL '.join(both(0, 'ertion'))}), best AS (SELECT corpus_ord, doc_ord, sum(s) AS score FROM leaves GROUP BY ALL) SELECT doc_ord, title || ': ' || path || ' (line 1) (score: ' || printf('%.2f', score) || ')' || chr(10) || '  ' || title || chr(10) AS shown FROM best JOIN listed USING (corpus_ord, doc_ord)")
def search_rendered(spark, d):
    found = ranked_plan(stored(spark, d), "ertion")
    return found.select(F.col("place").alias("doc_ord"), hit_text().alias("shown"))


# ---- functions on odd texts

ODD = "'हिन्दी-' || lang || ' E' || chr(769) || 'te_' || source"


@query(f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all({ODD}, '[\\p{{L}}\\p{{N}}\\x{{093F}}\\x{{0940}}]+'), lambda x: lower(x)), ',') AS tokens, array_to_string(list_filter(string_split(regexp_replace(lower({ODD}), '[^\\p{{L}}\\p{{N}}\\x{{093F}}\\x{{0940}}]', '-', 'g'), '-'), lambda x: x <> ''), '-') AS slug, false AS valid, 'हिन,दी' AS asked FROM documents")
def odd_letters(spark, d):
    """Marks that are letters to some tables of characters and not to others; the query side cuts alike."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = F.concat(F.lit("हिन्दी-"), "lang", F.lit(" E\u0301te_"), "source")
    cut = F.array_join(F.transform(tokens(odd), lambda t: t["term"]), ",")
    return docs.select("doc_id", cut.alias("tokens"), slug(odd).alias("slug"), is_identifier(odd).alias("valid"), F.lit(",".join(t for _, t in token_list("हिन्दी"))).alias("asked"))


@query(
    """WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS line, CASE WHEN doc_id % 4 = 0 THEN '../' WHEN doc_id % 4 = 1 THEN '/' WHEN doc_id % 4 = 2 THEN 'a..b/' ELSE '' END || source || '/' || doc_id AS path, text FROM documents)
SELECT doc_id, strlen(line) BETWEEN 1 AND 200 AS title, strlen(text) <= 1000 AND NOT contains(text, chr(0)) AS query, regexp_matches(text, '[^\\s]') AS filled, doc_id % 4 > 1 AS inside, contains(path, '..') AS refused, CASE WHEN doc_id % 2 = 0 THEN '/home/x/' || doc_id ELSE '~' || doc_id END AS home FROM t"""
)
def checks(spark, d):
    """Titles, queries, contents and paths that the commands take."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kind = F.pmod("doc_id", F.lit(4))
    path = F.concat(F.when(kind == 0, "../").when(kind == 1, "/").when(kind == 2, "a..b/").otherwise(""), "source", F.lit("/"), F.col("doc_id").cast("string"))
    home = configuration.expanded(F.concat(F.when(kind % 2 == 0, "~/").otherwise("~"), F.col("doc_id").cast("string")), "/home/x")
    return docs.select("doc_id", is_title(F.substring_index("text", "\n", 1)).alias("title"), is_literal_query(F.col("text")).alias("query"), is_filled(F.col("text")).alias("filled"), is_inside(path).alias("inside"), F.contains(path, F.lit("..")).alias("refused"), home.alias("home"))


# ---- the commands over folders: corpora of the benchmark's items, every fifth one not listed

_folders: dict[tuple[str, str], str] = {}
CONFIG = "config.toml"


def folder(spark, d) -> str:
    """A folder of this machine with two corpora of files and a configuration; the commands work on such."""
    path = scratch(spark, "corpora").removeprefix("file://").removeprefix("file:")
    root = path if path.startswith("/") else tempfile.mkdtemp(prefix="tomehall-corpora-")
    listed = {name: [] for name in ("one", "two")}
    for name in listed:
        os.makedirs(f"{root}/{name}/sub")
    for r in spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").toLocalIterator():
        name, place = ("one", "two")[r["item_id"] % 2], f"bench/{r['item_id']}.md"
        LocalStorage(f"{root}/{name}").write_document(place, (r["text"] or "").replace(". ", ".\n"))
        if r["item_id"] % 5:
            listed[name].append(Document(place, f"Item {r['item_id']}", f"c{r['item_id'] % 3}", [f"t{r['item_id'] % 4}"]))
    for name, docs in listed.items():
        LocalStorage(f"{root}/{name}").write_manifest(Manifest("1", docs))
    odd = {"_draft.md": b"draft of tion", "bad.md": b"\xff tion\ngood TION\r\n", ".hidden.md": b"tion", "bin.md": b"tion\0", "sub/manifest.json": b"tion", "log.tmp": b"tion", ".ignore": b"*.tmp\n"}
    for place, data in odd.items():
        with open(f"{root}/one/{place}", "wb") as f:
            f.write(data)
    with open(f"{root}/{CONFIG}", "w", encoding="utf-8") as f:
        f.write(f'[corpus]\npaths = ["{root}/one", "{root}/none", "{root}/two"]\n')
    return root


def corpora(spark, d) -> tuple[str, Engine]:
    """The folder of a session, indexed, and the commands over it; queries that change it make their own."""
    key = spark.sparkContext.applicationId, d
    if key not in _folders:
        root = folder(spark, d)
        Engine(spark, configuration.load(configuration.Path(f"{root}/{CONFIG}"))).index_all()
        _folders[key] = root
    return _folders[key], Engine(spark, configuration.load(configuration.Path(f"{_folders[key]}/{CONFIG}")))


def within_folder(root: str):
    return F.substring("path", len(root) + 2, 1 << 30).alias("path")


ITEMS = """items AS (SELECT item_id % 2 AS corpus_ord, item_id AS doc_ord, CASE item_id % 2 WHEN 0 THEN 'one' ELSE 'two' END AS root, 'bench/' || item_id || '.md' AS path, replace(coalesce(text, ''), '. ', '.' || chr(10)) AS content FROM benchmark),
listed AS (SELECT *, 'Item ' || doc_ord AS title, 'c' || doc_ord % 3 AS category, 't' || doc_ord % 4 AS tags FROM items WHERE doc_ord % 5 <> 0)"""
ITEM_HITS = """found AS (SELECT corpus_ord, root || '/' || path AS path, CASE WHEN doc_ord % 5 = 0 THEN doc_ord::VARCHAR ELSE 'Item ' || doc_ord END AS title, trim(line, ' ' || chr(9) || chr(13)) AS matched_line, line_number FROM
 (SELECT *, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM items) WHERE contains(lower(line), 'tion')
 UNION ALL SELECT 0, 'one/_draft.md', '_draft', 'draft of tion', 1 UNION ALL SELECT 0, 'one/bad.md', 'bad', 'good TION', 2)"""


@query(f"WITH {ITEMS}, {ITEM_HITS} SELECT path, title, matched_line, line_number FROM found")
def engine_search(spark, d):
    root, engine = corpora(spark, d)
    return engine.search("tion", limit=None).select(within_folder(root), "title", "matched_line", "line_number")


@query(f"WITH {ITEMS}, {ITEM_HITS} SELECT path, line_number FROM (SELECT * FROM found JOIN listed ON found.path = root || '/' || listed.path WHERE category = 'c1') ORDER BY found.corpus_ord, found.path, line_number LIMIT 7".replace("SELECT path, line_number FROM (SELECT * FROM", "SELECT path, line_number FROM (SELECT found.* FROM").replace("found.corpus_ord, found.path, line_number LIMIT", "corpus_ord, path, line_number LIMIT"))
def engine_search_category(spark, d):
    root, engine = corpora(spark, d)
    return engine.search("TION", limit=7, category="c1").select(within_folder(root), "line_number")


@query(f"WITH {ITEMS} SELECT title, category, tags, root || '/' || path AS path FROM listed")
def engine_list(spark, d):
    root, engine = corpora(spark, d)
    return engine.list_documents().select("title", "category", F.array_join("tags", ", ").alias("tags"), within_folder(root))


@query(f"WITH {ITEMS} SELECT path, content FROM listed")
def engine_get(spark, d):
    """Each listed document by its path."""
    root, engine = corpora(spark, d)
    paths = [x.path for name in ("one", "two") for x in LocalStorage(f"{root}/{name}").load_manifest().documents]
    return spark.createDataFrame([(p, engine.get(p)) for p in paths], "path string, content string")


@query(f"WITH {ITEMS}, {TOKENS}, leaves AS ({' UNION ALL '.join(both(0, 'the') + both(1, 'item'))}) SELECT root || '/' || path AS path, round(sum(s), 6) AS score FROM leaves JOIN listed USING (corpus_ord, doc_ord) GROUP BY ALL")
def engine_ranked(spark, d):
    root, engine = corpora(spark, d)
    return engine.search("the item", limit=100_000, backend=Backend.RANKED).select(within_folder(root), F.round("score", 6).alias("score"))


@query(f"WITH {ITEMS} SELECT 'one/' || path AS path, title, content FROM listed WHERE root = 'one' UNION ALL SELECT * FROM (VALUES ('one/notes/first-one.md', 'First: One!', 'body'), ('one/notes/été.md', 'Été', ''))")
def engine_add(spark, d):
    """Two documents more; one whose file exists is refused."""
    root = folder(spark, d)
    engine = Engine(spark, configuration.Config([f"{root}/one"]))
    engine.add("First: One!", "body", "notes", "a, b")
    engine.add("Été", "", "notes")
    with contextlib.suppress(AlreadyExists):
        engine.add("first one", "other", "notes")
    shown = [(f"one/{x.path}", x.title, engine.get(x.path)) for x in LocalStorage(f"{root}/one").load_manifest().documents]
    return spark.createDataFrame(shown, "path string, title string, content string")


@query(f"""WITH {ITEMS}, {ITEM_HITS}, top AS (SELECT * FROM found ORDER BY corpus_ord, path, line_number LIMIT 50)
SELECT string_agg(title || ': ' || path || ' (line ' || line_number || ')' || chr(10) || '  ' || matched_line || chr(10), chr(10) ORDER BY corpus_ord, path, line_number) || chr(10) || count(*) || ' result(s) found' || chr(10) AS shown FROM top""")
def engine_cli(spark, d):
    """What the command line prints."""
    root, _ = corpora(spark, d)
    out, before = io.StringIO(), os.environ.get(configuration.ENV)
    os.environ[configuration.ENV] = f"{root}/{CONFIG}"
    try:
        with contextlib.redirect_stdout(out):
            cli.main(["search", "tion", "-l", "50"], spark)
    finally:
        os.environ.pop(configuration.ENV)
        if before is not None:
            os.environ[configuration.ENV] = before
    return spark.createDataFrame([(out.getvalue().replace(root + "/", ""),)], "shown string")
