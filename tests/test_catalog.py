"""Each registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from tomehall.catalog import ORACLES, QUERIES

TABLES = "documents labels pages conversations benchmark".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) >= 61


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    found = sql.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(names) == columns and sorted(got, key=key) == sorted(want, key=key)


def test_pushdown(spark, sf):
    """The category reaches the scan, and one-column projections read what they need."""
    from pyspark.sql import functions as F

    from tomehall.operators.literal import matching_lines
    from tomehall.sources import tables

    plan = matching_lines(tables.files(spark, sf).where(F.col("category") == "src3"), "thing")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan and "Exchange" not in plan


def test_index_cuts_texts_once(spark, sf):
    """Each field is cut into tokens in one place of the plan, and not where documents are filtered."""
    from tomehall.operators.index import build
    from tomehall.sources import tables

    plan = build(tables.documents(spark, sf)).postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2, plan


def test_index_buckets_have_tasks_of_their_own(spark, sf, tmp_path, monkeypatch):
    from tomehall.operators import index
    from tomehall.sources import tables

    monkeypatch.setattr(index, "BUCKET_BYTES", 5000)
    index.save(index.build(tables.documents(spark, sf)), str(tmp_path))
    for t in ("postings", "terms"):
        files = [(f.parent.name, f.name.split("-")[1]) for f in (tmp_path / t).glob("bucket=*/*.parquet")]
        assert len(files) == len({b for b, _ in files}) == len({task for _, task in files}) > 8, files


def test_fuzzy_looks_at_lengths_first(spark, sf, tmp_path):
    from tomehall.catalog import stored
    from tomehall.operators.ranked import fuzzy

    plan = fuzzy(stored(spark, sf), "oning", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "length(term" in plan and plan.index("length(term") < plan.index("levenshtein(")
