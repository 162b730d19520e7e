import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomehall import config
from tomehall.functions import text, validate
from tomehall.model import InvalidInput

SLUGS = [("Error Handling", "error-handling"), ("What's New?", "what-s-new"), ("Top 10 Tips", "top-10-tips"), ("a   b", "a-b"), ("", ""), ("!!!", ""), ("Café au lait", "café-au-lait")]
TAGS = [("rust", ["rust"]), ("a,b", ["a", "b"]), (" a , b ", ["a", "b"]), ("", []), (None, []), ("a,,b,", ["a", "b"]), ("b,a,b", ["b", "a", "b"])]
STEMS = [("x/a.b.md", "a.b"), (".hid", ".hid"), ("x/plain", "plain"), ("a.md", "a")]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_slugs(spark):
    assert [text.slugify(t) for t, _ in SLUGS] == [s for _, s in SLUGS]
    assert column(spark, [t for t, _ in SLUGS], text.slug) == [s for _, s in SLUGS]


def test_tags(spark):
    assert [text.parse_tag_list(t) for t, _ in TAGS] == [s for _, s in TAGS]
    assert column(spark, [t for t, _ in TAGS], text.parse_tags) == [s for _, s in TAGS]


def test_stems_and_trim(spark):
    assert column(spark, [t for t, _ in STEMS], text.file_stem) == [s for _, s in STEMS]
    assert column(spark, ["  a b\t "], text.trimmed) == ["a b"]


def test_tokens_keep_positions_of_dropped_ones(spark):
    long, fits = "x" * 40, "y" * 39
    assert [tuple(r) for r in column(spark, [f"Ab {long} {fits} c-d"], text.tokens)[0]] == [(0, "ab"), (2, fits), (3, "c"), (4, "d")]


def test_quantised_lengths(spark):
    cases = {0: 0, 23: 23, 24: 24, 40: 40, 41: 40, 55: 54, 97: 96, 111: 104, 153: 152}
    assert column(spark, list(cases), text.quantised_length, "long") == [float(v) for v in cases.values()]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("word", ["abc", "abca", "lambda", "ca", "été"])
def test_restricted_distance(spark, word):
    rng = random.Random(word)
    others = {"".join(rng.choices(sorted(set(word)) + ["z"], k=rng.randint(0, 6))) for _ in range(300)} | {word, "abc", word[::-1]}
    others = sorted(others)
    for d in range(3):
        assert column(spark, others, lambda c, d=d: text.within(word, c, d)) == [osa(word, o) <= d for o in others]


def test_identifiers(spark):
    good, bad = ["rust", "a-b", "a_b", "r2", "9a", "é"], ["", "a/b", "-a", "a b", "a" * 201, "../etc", "a\n"]
    assert column(spark, good + bad, validate.is_identifier) == [True] * len(good) + [False] * len(bad)
    for g in good:
        validate.identifier(g, "tag")
    for b in bad:
        with pytest.raises(InvalidInput):
            validate.identifier(b, "tag")


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=20))
def test_slug_is_path_safe(spark, t):
    assert "/" not in text.slugify(t) and ".." not in text.slugify(t) and not text.slugify(t).startswith("-")


SCRIPTS = ["हिन्दी भाषा", "ภาษาไทย", "العربيّة", "עִבְרִית", "e\u0301te", "İstanbul ΑΣ", "²x ½", "a_b-c", "日本語 テキスト", "ǅ ﬁn", "x\u200dy", "𝟘a 𐐀"]


@pytest.mark.parametrize("t", SCRIPTS)
def test_driver_and_columns_agree(spark, t):
    """One analyser: queries, names and slugs are cut as documents are."""
    from tomehall.plans.grammar import analysed

    cut = [tuple(r) for r in column(spark, [t], text.tokens)[0]]
    assert list(text.token_list(t)) == cut and text.slugify(t) == column(spark, [t], text.slug)[0]
    leaf = analysed("content", t)
    assert leaf is None or list(leaf.terms) == [x for _, x in cut]
    for w in t.split():
        try:
            validate.identifier(w, "tag")
            valid = True
        except InvalidInput:
            valid = False
        assert column(spark, [w], validate.is_identifier) == [valid]


def test_config(tmp_path, monkeypatch):
    assert config.expand_tilde("~") == "~" and config.expand_tilde("/a") == "/a" and config.expand_tilde("~/a").endswith("/a")
    monkeypatch.setenv(config.ENV, str(tmp_path / "c.toml"))
    assert config.load().paths == config.Config().paths
    (tmp_path / "c.toml").write_text("[corpus]\npaths = []\n")
    assert config.load().roots == []
    (tmp_path / "c.toml").write_text("not toml [")
    with pytest.raises(InvalidInput):
        config.load()
