import io
import json

import pytest

from tomehall import cli, tools
from tomehall.commands import Engine
from tomehall.config import Config
from tomehall.model import AlreadyExists, Backend, InvalidInput, NotFound, QuerySyntax, TomehallError
from tomehall.store import LocalStorage

BODIES = {
    "rust/error-handling.md": ("Error Handling", "rust", ["rust", "errors"], "# Errors\n\nUse Result for errors. Ask for help."),
    "aws/lambda-patterns.md": ("Lambda Patterns", "aws", ["aws", "lambda"], "# Lambda\n\nPatterns for lambda functions. Cold starts."),
}


def corpus(root, bodies=BODIES):
    root.mkdir(parents=True, exist_ok=True)
    for path, (_, _, _, body) in bodies.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    listed = [{"path": p, "title": t, "category": c, "tags": g} for p, (t, c, g, _) in bodies.items()]
    (root / "manifest.json").write_text(json.dumps({"version": "1", "documents": listed}))
    return str(root)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Config([corpus(tmp_path / "one")]))


def titles(df):
    return [r["title"] for r in df.collect()]


def test_literal_search(engine):
    rows = engine.search("LAMBDA").collect()
    assert [(r["title"], r["line_number"], r["matched_line"], r["score"]) for r in rows] == [("Lambda Patterns", 1, "# Lambda", None), ("Lambda Patterns", 3, "Patterns for lambda functions. Cold starts.", None)]
    assert rows[0]["path"].endswith("one/aws/lambda-patterns.md")
    assert titles(engine.search("LAMBDA", case_sensitive=True)) == []
    assert len(titles(engine.search("for"))) == 2 and len(titles(engine.search("for", limit=1))) == 1
    assert titles(engine.search("for", category="rust")) == ["Error Handling"]
    assert titles(engine.search("")) == [] and titles(engine.search("a\nb")) == [] and titles(engine.search("r.r")) == []
    with pytest.raises(TomehallError, match="too long"):
        engine.search("x" * 1001)
    with pytest.raises(TomehallError):
        engine.search("a\0b")


def test_what_is_scanned(spark, tmp_path):
    root = tmp_path / "c"
    corpus(root)
    for name, data in {"orphan.md": b"needle", ".hidden": b"needle", "sub/manifest.json": b"needle", "bin.md": b"needle\0", "bad.md": b"\xff needle\nneedle two\r\n", "sp ace.md": b"needle"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    engine = Engine(spark, Config([str(root)]))
    rows = [(r["path"].rsplit("/", 1)[1], r["title"], r["matched_line"]) for r in engine.search("needle").collect()]
    assert rows == [("bad.md", "bad", "needle two"), ("orphan.md", "orphan", "needle"), ("sp ace.md", "sp ace", "needle")]
    assert len(titles(engine.search("needle", category="unknown"))) == 3
    with pytest.raises(NotFound):
        engine.get("orphan.md")


def test_ignore_files_and_underscores(spark, tmp_path):
    root = tmp_path / "c"
    corpus(root, {"_notes/_draft.md": ("Draft", "n", [], "needle in a draft")})
    for name in ("keep.md", "a.log", "sub/b.log", "sub/keep.log", "build/x.md", "sub/build/y.md", "deep/q/z.md", "_top.md", "sub/_in.txt", "_gone/x.md", "git.tmp"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("needle")
    (root / ".ignore").write_text("# logs\n*.log\n!keep.log\n/build/\ndeep/**/z.md\n_gone/\n")
    (root / ".gitignore").write_text("*.tmp\n")
    (root / "sub/.ignore").write_text("build\n")
    found = lambda: sorted(r["path"][len(str(root)) + 1 :] for r in Engine(spark, Config([str(root)])).search("needle", limit=None).collect())
    kept = ["_notes/_draft.md", "_top.md", "git.tmp", "keep.md", "sub/_in.txt", "sub/keep.log"]
    assert found() == kept
    (root / ".git").mkdir()
    assert found() == [x for x in kept if x != "git.tmp"]
    engine = Engine(spark, Config([str(root)]))
    heard = []
    assert engine.index_all(heard.append) == 1 and heard == [str(root)]
    assert titles(engine.search("draft", backend=Backend.RANKED)) == ["Draft"]


def test_snapshots_and_other_file_systems(spark, tmp_path, engine):
    import os

    root = engine.config.roots[0]
    engine.index_all()
    open_search = engine.search("lambda", backend=Backend.RANKED)
    engine.index_all()
    assert titles(open_search) == ["Lambda Patterns"]  # planned on the snapshot before
    engine.index_all()
    assert sum(n.startswith("v") for n in os.listdir(os.path.join(root, ".index"))) == 2
    with pytest.raises(TomehallError, match="file systems"):
        Engine(spark, Config(["s3a://bucket/corpus"])).search("x")


def test_fuzzy_reads_its_buckets(spark, tmp_path):
    """A stored index prunes the buckets of fuzzy words, ranges and sets."""
    from tomehall.operators.index import build, load, save
    from tomehall.operators.ranked import fuzzy, scored
    from tomehall.plans.grammar import parse

    docs = spark.createDataFrame([(0, i, f"p{i}", f"title w{i}", "c", ["t"], f"word w{i} x{i % 7} " * 3) for i in range(300)], "corpus_ord int, doc_ord long, path string, title string, category string, tags array<string>, content string")
    save(build(docs), str(tmp_path / "i"))
    index = load(spark, str(tmp_path / "i"))
    assert index.buckets == 8
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan(fuzzy(index, "w12", 1)) and "dynamicpruning" in plan(scored(index, parse("content:[w1 TO w12]")))
    assert "bucket" in plan(scored(index, parse("content: IN [w1 w2]"))).split("PartitionFilters")[1][:200]
    assert fuzzy(index, "w12", 1).count() == fuzzy(build(docs), "w12", 1).count() > 10


def test_ranked_routing_and_staleness(engine):
    with pytest.raises(TomehallError, match="index"):
        engine.search("lambda", backend=Backend.RANKED)
    assert engine.search("lambda", backend=Backend.AUTO).first()["score"] is None
    assert engine.index_all() == 1
    top = engine.search("lambda", backend=Backend.AUTO).collect()
    assert [r["title"] for r in top] == ["Lambda Patterns"] and top[0]["score"] > 0 and top[0]["matched_line"] == "Lambda Patterns" and top[0]["line_number"] == 1
    assert titles(engine.search("errors AND help", backend=Backend.RANKED)) == ["Error Handling"]
    assert titles(engine.search('"cold starts" -errors', backend=Backend.RANKED)) == ["Lambda Patterns"]
    assert titles(engine.search("lamdba", backend=Backend.RANKED, fuzzy=1)) == ["Lambda Patterns"]
    assert titles(engine.search("lamb", backend=Backend.RANKED, fuzzy=1)) == []
    assert titles(engine.search("lambda", backend=Backend.RANKED, limit=0)) == [] == titles(engine.search(" ", backend=Backend.RANKED))
    assert titles(engine.search("for", backend=Backend.RANKED, category="aws")) == ["Lambda Patterns"]
    with pytest.raises(TomehallError):
        engine.search("tags:x", backend=Backend.RANKED)
    engine.add("Lambda Two", "lambda lambda lambda", "aws", "new")
    assert titles(engine.search("lambda", backend=Backend.RANKED)) == ["Lambda Patterns"]
    engine.index_all()
    assert set(titles(engine.search("lambda", backend=Backend.RANKED))) == {"Lambda Patterns", "Lambda Two"}


def test_index_modes(spark, tmp_path):
    from tomehall.backends import LiteralBackend, RankedBackend
    from tomehall.model import IndexMissing, IndexMode, Manifest, ReadOnlyIndex, SearchOptions

    root = corpus(tmp_path / "c")
    with pytest.raises(IndexMissing):
        RankedBackend(spark, root, Manifest(), IndexMode.READ_ONLY)
    new = RankedBackend(spark, root, Manifest(), IndexMode.READ_WRITE)
    with pytest.raises(IndexMissing):
        new.search("x", SearchOptions())
    assert new.needs_indexing() and not LiteralBackend(spark, root, Manifest()).needs_indexing()
    new.index()
    with pytest.raises(ReadOnlyIndex):
        RankedBackend(spark, root, Manifest(), IndexMode.READ_ONLY).index()


def test_corpora_and_errors(spark, tmp_path):
    one, two = corpus(tmp_path / "one"), corpus(tmp_path / "two", {"cat/doc.md": ("Doc", "cat", [], "for all")})
    assert len(titles(Engine(spark, Config([one, two, str(tmp_path / "none")])).search("for"))) == 3
    broken = tmp_path / "broken"
    broken.mkdir()
    with pytest.raises(TomehallError, match="Search failed"):
        Engine(spark, Config([str(broken)])).search("for")
    (broken / "manifest.json").write_text("not valid json")
    with pytest.raises(TomehallError, match="List failed"):
        Engine(spark, Config([str(broken)])).list_documents()
    assert len(titles(Engine(spark, Config([str(broken), two])).search("for"))) == 1
    assert Engine(spark, Config([])).list_documents().count() == 0


def test_mixed_backends_put_unscored_last(spark, tmp_path):
    one, two = corpus(tmp_path / "one"), corpus(tmp_path / "two")
    Engine(spark, Config([two])).index_all()
    scores = [r["score"] for r in Engine(spark, Config([one, two])).search("lambda", backend=Backend.AUTO).collect()]
    assert scores[0] is not None and scores[1:] == [None, None]


def test_add_and_get(spark, tmp_path):
    root = tmp_path / "one"
    engine = Engine(spark, Config([corpus(root, {})]))
    doc = engine.add("My Title!", "body", "cat", " a, b ")
    assert doc.path == "cat/my-title.md" and doc.tags == ["a", "b"] and engine.get(doc.path) == "body"
    with pytest.raises(AlreadyExists):
        engine.add("My Title", "again", "cat")
    for bad in ({"title": ""}, {"title": "x" * 201}, {"category": "../x"}, {"tags": "a b"}):
        with pytest.raises(InvalidInput):
            engine.add(**{"title": "T", "content": "c", "category": "cat"} | bad)
    for bad in ("../x", "a..b.md"):
        with pytest.raises(InvalidInput):
            engine.get(bad)
    (root / "cat/my-title.md").unlink()
    with pytest.raises(NotFound):
        engine.get(doc.path)
    (root / "out").symlink_to(tmp_path)
    with pytest.raises(InvalidInput):
        LocalStorage(str(root)).write_document("out/x.md", "x")
    with pytest.raises(InvalidInput):
        Engine(spark, Config([str(tmp_path / "none")])).add("T", "c", "cat")


def test_cli(spark, tmp_path, monkeypatch, capsys):
    one = corpus(tmp_path / "one", BODIES | {"x/plain.md": ("Plain", "x", [], "nothing")})
    (tmp_path / "c.toml").write_text(f'[corpus]\npaths = ["{one}"]\n')
    monkeypatch.setenv("TOMEHALL_CONFIG", str(tmp_path / "c.toml"))
    run = lambda *a: (cli.main(list(a), spark), *capsys.readouterr())
    code, out, _ = run("search", "cold")
    assert code == 0 and out.startswith("Lambda Patterns: ") and "(line 3)\n  Patterns for" in out and out.endswith("1 result(s) found\n")
    assert "x: Plain\n" in run("list")[1] and "rust: Error Handling [rust, errors]\n" in run("list", "-c", "rust")[1]
    monkeypatch.setattr("sys.stdin", io.StringIO("  "))
    assert run("add", "-t", "T", "-C", "c")[0] == 1
    monkeypatch.setattr("sys.stdin", io.StringIO("hello"))
    assert run("add", "-t", "New One", "-C", "c", "-T", "a")[1] == "Added: New One\nCategory: c\nPath: c/new-one.md\n"
    assert run("get", "c/new-one.md")[1] == "hello"
    assert run("search", "x", "-f", "3")[0] == 1 and run("get", "none.md")[0] == 1 and run()[0] == 0
    assert "1 corpora" in run("index")[1]
    assert "(score: " in run("search", "lambda", "-b", "auto")[1]


def test_tools(engine):
    ask = lambda name, **a: tools.answer(engine, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})
    assert "Lambda Patterns" in ask("search_knowledge", query="lambda")["result"]["content"][0]["text"]
    assert ask("get_document", path="none")["error"]["code"] == tools.INTERNAL_ERROR
    assert "Added" in ask("add_knowledge", title="A B", content="", category="c")["result"]["content"][0]["text"]
    assert "A B" in ask("list_knowledge", category="c")["result"]["content"][0]["text"]
    out = io.StringIO()
    tools.serve(engine, io.StringIO('{"id":1,"method":"initialize"}\n{"method":"notifications/initialized"}\nnot json\n{"id":2,"method":"tools/list"}\n'), out)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert all(t["description"] and all(p["description"] for p in t["inputSchema"]["properties"].values()) for t in lines[2]["result"]["tools"]) and lines[0]["result"]["instructions"]
    engine.search = lambda *a, **k: 1 / 0
    assert ask("search_knowledge", query="x")["error"]["code"] == tools.INTERNAL_ERROR and ask("search_knowledge", nothing=1)["error"]["code"] == tools.INTERNAL_ERROR
    for odd in ([], "x", None, 3, {"id": 1, "params": [1]}):
        assert tools.answer(engine, odd)["error"]["code"] == tools.BAD_REQUEST
    assert len(lines) == 3 and len(lines[2]["result"]["tools"]) == 4 and lines[1]["error"]["code"] == tools.BAD_REQUEST


@pytest.mark.parametrize("bad", ['"open', "(a", "a)", "AND a", "nofield:x", "/re/", "title:*"])
def test_syntax_errors(spark, bad):
    from tomehall.plans.grammar import parse

    with pytest.raises(QuerySyntax):
        parse(bad)


def test_streaming(spark, tmp_path):
    from tomehall.streaming.live import arriving, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\nTwo needles\n")
    (tmp_path / "in/b.txt").write_text("none")
    q = watch(arriving(spark, str(tmp_path / "in")), "NEEDLE").writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["matched_line"], r["line_number"]) for r in spark.table("live").collect()] == [("Two needles", 2)]
