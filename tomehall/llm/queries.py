"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontamination import contaminated
from .jaccard_join import link
from .language_id import identify
from .lm_score import score_folds
from .media import inspect, store
from .packing import pack
from .pii import detect
from .quality import rate
from .substring_dedup import remove_repeats
from .token_counts import count_tokens


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(store(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_folds(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: In the order of the list of operators.
QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_media_columns,
        op3_language_id,
        op4_lm_score,
        op5_ngram_jaccard_join,
        op6_best_fit_packing,
        op7_pii,
        op8_token_counts,
        op9_quality_classifier,
        op10_benchmark_decontamination,
    )
}

#: Words of every text in order.
WORDS = """words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents))"""


def following(n: int) -> str:
    return " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER d" for k in range(1, n))])


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for the queries that it can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""WITH {WORDS.format(text="coalesce(text, '')")},
windows AS (SELECT doc_id, i, {following(13)} AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
earliest AS (SELECT g, min(doc_id) AS m FROM windows WHERE g IS NOT NULL GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM windows JOIN earliest USING (g) WHERE m < doc_id),
sums AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS kept FROM words w LEFT JOIN gone g USING (doc_id, i) GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN sums USING (doc_id)""",
    "op5_ngram_jaccard_join": f"""WITH RECURSIVE {WORDS.format(text=LOWER)},
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, {following(5)} AS s FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WHERE s IS NOT NULL
 UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY i) FROM words GROUP BY doc_id HAVING count(*) < 5),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM sides UNION SELECT r.x, s.y FROM reach r JOIN sides s ON r.y = s.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id FROM documents LEFT JOIN sizes USING (doc_id)""",
}
