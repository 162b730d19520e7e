"""The pipeline's stages against brute force on their own inputs."""

import corpus_pipeline
from test_operators import components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * len(before)
    kept = corpus_pipeline.jaccard_join(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in components(before)})
    kept = corpus_pipeline.decontamination(spark, docs, sf)
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [i for i, t in before if not any(x in " ".join(t.lower().split()) for x in items)]
    assert sorted(r.doc_id for r in kept.collect()) == want and len(want) < len(before)
    masked = {r.doc_id: r for r in corpus_pipeline.pii(spark, docs, sf).collect()}
    assert all("@mail" not in r.text and r.n_chars == len(r.text) for r in masked.values())
    assert sum(r.text == t for (i, t) in before for r in [masked[i]]) > 0.8 * len(before)


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 100 and {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)


def test_hard_rows(spark, sf):
    rows = [(1, "one two three", None, "s", 1), (1, "one two three", None, "s", 1), (None, "a b c d e f g", "en", "s", 2), (2, None, "en", "s", 0), (3, "", "fr", None, 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.jaccard_join(spark, docs, sf).count() == 5
    assert corpus_pipeline.decontamination(spark, docs, sf).count() == 6
    assert corpus_pipeline.pii(spark, docs, sf).count() == 6
    assert corpus_pipeline.language_id(spark, docs, sf).count() == 3
    assert all(f(spark, docs.where("false"), sf).count() == 0 for _, f in corpus_pipeline.STAGES)
