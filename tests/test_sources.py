"""Scans of real trees, tables, the engine and the change stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from symbolith.facade import Engine
from symbolith.sources import files as S
from symbolith.sources import tables
from symbolith.streaming import watch


def tree(root, files):
    for p, text in files.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


def names(spark, root, **options):
    return {r["path"] for r in S.scan(S.read_tree(spark, str(root)), **options).collect()}


def test_skip_rules(spark, tmp_path):
    tree(tmp_path, {"a.js": "x", "data/b.js": "x", "node_modules/c.js": "x", ".hidden/d.js": "x", "my backup/e.js": "x", "src/.f.js": "x", "src/g.txt": "x", "src/h.py": "x"})
    assert names(spark, tmp_path) == {"a.js", "src/h.py"}
    assert names(spark, tmp_path, include_dirs=("data", "node_modules")) == {"a.js", "src/h.py", "data/b.js"}
    assert names(spark, tmp_path, skip_dirs=("src",)) == {"a.js"}


def test_limits(spark, tmp_path):
    tree(tmp_path, {"a.js": "x", "b.js": "x", "c.js": "x", "d/e/f.js": "x"})
    rows = S.scan(S.read_tree(spark, str(tmp_path)), max_files=2).collect()
    assert [r["path"] for r in rows] == ["a.js", "b.js"] and rows[0]["truncated"]
    rows = S.scan(S.read_tree(spark, str(tmp_path)), max_depth=1).collect()
    assert len(rows) == 3 and rows[0]["depth_truncated"] and not rows[0]["truncated"]


def test_gitignore(spark):
    lines = spark.createDataFrame(list(enumerate(["# c", "out/", "tmp", "!out", "*.log", " gen "])), "line_no int, text string")
    assert {r["dir"] for r in S.gitignore_dirs(lines).collect()} == {"tmp", "gen"}


def test_tables(spark, tmp_path):
    assert tables.read(spark, str(tmp_path / "none"))[0] == "missing"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("nonsense")
    assert tables.read(spark, str(tmp_path / "bad"))[0] == "corrupt"
    tables.write(spark.range(3), str(tmp_path / "t"))
    assert tables.read(spark, str(tmp_path / "t"), ("id",))[0] == "ok"
    assert tables.read(spark, str(tmp_path / "t"), ("other",))[0] == "corrupt"


def test_block_is_replaced():
    once = tables.upsert_block("# Notes\n", "a")
    twice = tables.upsert_block(once, r"b \1")
    assert "a" in once and twice.count(tables.BLOCK_START) == 1 and r"b \1" in twice and "# Notes" in twice


def test_servers(spark):
    conf = spark.createDataFrame(
        [("a.json", "json", '{"mcpServers": {"one": {}, "two": {}}}'), ("b.toml", "toml", '[mcp_servers."three"]\nx = 1\n[other]')], "source string, kind string, content string"
    )
    assert {r["name"] for r in tables.server_entries(conf).collect()} == {"one", "two", "three"}
    servers = spark.createDataFrame([("r", "git-a", "x", "repo", 1), ("u", "git-b", "x", "user", 2)], "source string, name string, command string, scope string, score int")
    gone = tables.redundant_servers(servers, spark.createDataFrame([("git", "git")], "profile string, pattern string")).collect()
    assert [(r["name"], r["keeper"]) for r in gone] == [("git-a", "u:git-b")]


def test_backups(spark):
    rows = spark.createDataFrame([("f", i, f"b{i}") for i in range(5)], "file string, ts int, name string")
    assert {r["name"] for r in tables.keep_newest(rows).collect()} == {"b4", "b3", "b2"}


def test_engine(spark, tmp_path):
    src, home = tmp_path / "p", tmp_path / "home"
    tree(src, {"src/a.js": "export function makeWidget() {}\nrouter.get('/api/w/:id', f)\n", "src/b.py": "def helper():\n    pass\n", "src/p.html": "<title>P</title>"})
    e = Engine(spark, str(home), "2024-01-10 00:00:00")
    with pytest.raises(LookupError, match="missing"):
        e.check(["x"])
    assert e.reindex(str(src)) == {"files": 3, "truncated": False, "depth_truncated": False, "cache_hits": 0}
    got = [(r["q"], r["verdict"]) for r in e.check(["makeWidget", "makeWidgett", "ghostFn"]).collect()]
    assert got == [("makeWidget", "known"), ("makeWidgett", "fuzzy"), ("ghostFn", "unknown")]
    e.check(["ghostFn"])
    e.check(["ghostFn"])
    assert [tuple(r) for r in e.watchlist().collect()] == [("ghostFn", 3)]
    (src / "src/b.py").write_text("def helper_two():\n    pass\n\n")
    assert e.refresh(str(src))["cache_hits"] == 2
    got = {r["q"]: r["verdict"] for r in e.check(["helper_two", "makeWidget"], record=False).collect()}
    assert got == {"helper_two": "known", "makeWidget": "known"}
    found = e.references(spark.createDataFrame([("src/n.js", "import './nope';\nmakeWidgt();\nfetch('/api/w/3'); fetch('/api/q')")], "path string, content string")).collect()
    assert {(r["finding"], r["name"]) for r in found} == {("import", "./nope"), ("typo", "makeWidgt"), ("route", "/api/q")}
    assert e.notes() == []
    assert Engine(spark, str(home), "2024-03-01").notes()[0].startswith("registry is ")
    assert e.overview()["counts"].count() >= 2
    e.clear_events()
    assert e.watchlist().count() == 0
    with pytest.raises(ValueError):
        Engine(spark, str(home), "2024-01-01", disabled=["check"]).call("check", [])


def test_engine_tools(spark, tmp_path):
    src, home = tmp_path / "p", tmp_path / "home"
    tree(src, {"src/a.js": "export function makeWidget() {}\n", "made/x.js": "export function ghost() {}\n", ".gitignore": "made/\n", "cfg.json": '{"skipDirs": ["off"]}', "off/y.js": "function lost() {}\n"})
    e = Engine(spark, str(home), "2024-01-10 00:00:00")
    assert e.prompt().endswith("index the project first.")
    assert e.reindex(str(src), config=str(src / "cfg.json"))["files"] == 2  # a.js and cfg.json
    files = spark.createDataFrame([("src/n.js", "import { makeWidget, other } from './a';\nmakeWidgt();")], "path string, content string")
    assert {(r["finding"], r["name"]) for r in e.references(files).collect()} == {("not exported", "other"), ("typo", "makeWidgt")}
    assert [r["content"] for r in e.autofix(files).collect()] == ["import { makeWidget, other } from './a';\nmakeWidget();"]
    out = spark.createDataFrame([("npm test", "x\n" * 400), ("ls -la", "a")], "command string, raw string")
    e.condense(out)
    e.condense(out)
    total = [r for r in e.condensing_report()["totals"].collect() if r["is_total"] == 1]
    assert [r["commands"] for r in total] == [4]
    e.reset_condensing()
    assert e.condensing_report()["top"].count() == 0
    once = e.agent_notes("# Mine\n")
    assert once.startswith("# Mine") and "functions: 1" in once and e.agent_notes(once) == once
    assert "symbols in 2 files" in e.prompt()


def test_changes(spark):
    kind = "path string, size long, mtime int"
    a = spark.createDataFrame([("a.js", 1, 1), ("b.js", 1, 1), ("c.js", 1, 1), ("n.txt", 1, 1)], kind)
    b = spark.createDataFrame([("a.js", 1, 1), ("b.js", 2, 2), ("d.js", 1, 1)], kind)
    assert {tuple(r) for r in watch.changes(a, b).collect()} == {("b.js", "modified"), ("c.js", "deleted"), ("d.js", "added")}


def test_stream_debounces(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    kind = "project string, path string, ts timestamp"
    rows = [("p", "a.js", t0), ("p", "b.js", t0 + dt.timedelta(milliseconds=500)), ("p", "a.js", t0 + dt.timedelta(milliseconds=900)), ("p", "c.js", t0 + dt.timedelta(seconds=5)), ("p", "z.js", t0 + dt.timedelta(hours=1))]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("p", "z.js", t0 + dt.timedelta(hours=2))], kind).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    seen = []
    query = watch.flushes(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    query.foreachBatch(lambda df, _: seen.extend(tuple(r["paths"]) for r in df.collect())).start().awaitTermination(120)
    assert {("a.js", "b.js"), ("c.js",)} <= set(seen)


def test_truncation_flag_counts_code_only(spark, tmp_path):
    tree(tmp_path, {"a.js": "x", "b.txt": "x"})
    assert not S.scan(S.read_tree(spark, str(tmp_path)), max_files=1).select(F.max("truncated")).first()[0]
