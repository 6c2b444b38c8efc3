"""Tables, deltas, diffs, watching and streams."""

import datetime as dt
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from symbolith.facade import Engine
from symbolith.operators import analytics, delta, diff, registry
from symbolith.sources import tables, tree_stream
from symbolith.streaming import debounce, watch

DEFS = "category string, name string, file string, line int, pass int"


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


# --- Tables ---


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    tables.write(spark.range(3), at)
    boom = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception):
        tables.write(spark.range(5).select(boom("id").alias("id")), at)
    assert tables.read(spark, at)[1].count() == 3
    with monkeypatch.context() as m:  # the files are there, the pointer isn't moved
        m.setattr(tables, "_move", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            tables.write(spark.range(7), at)
    assert tables.read(spark, at)[0] == "ok" and tables.read(spark, at)[1].count() == 3
    assert len(tables.vacuum(spark, at)) == 2 and tables.read(spark, at)[1].count() == 3
    for n in range(1, 5):
        tables.write(spark.range(n), at)
    assert tables.read(spark, at)[1].count() == 4
    assert len([x for x in os.listdir(at) if x.startswith("v=")]) == tables.KEEP


def test_two_writers_from_one_pointer(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.write(spark.range(1), at)
    folder = tables._Folder(spark, at)
    number, now = tables._pointer(folder)
    tables._move(folder, number, now)
    with pytest.raises(tables.Conflict):
        tables._move(folder, number, now)
    assert not [x for x in os.listdir(at) if x.startswith("_tmp")]


def test_appends_never_share_a_number(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "log")
    monkeypatch.setattr(tables, "COMPACT", 4)
    errors = []

    def add(k):
        try:
            tables.append_numbered(spark.range(3).select(F.lit(k).alias("writer")), at)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    df = tables.read(spark, at)[1]
    assert not errors and df.count() == 18 and df.select("seq").distinct().count() == 18
    top = df.agg(F.max("seq")).first()[0]
    tables.clear(spark, at)
    assert tables.read(spark, at)[1].count() == 0
    add(9)
    assert tables.read(spark, at)[1].agg(F.min("seq")).first()[0] > top


def test_buckets(spark, tmp_path):
    at = str(tmp_path / "b")
    rows = spark.range(100).select("id", (F.col("id") % 8).cast("int").alias("bucket"))
    tables.write(rows, at, "bucket")
    tables.replace_buckets(spark.createDataFrame([(500, 3)], "id long, bucket int"), at, [3, 4])
    got = tables.read(spark, at)[1]
    assert got.count() == 100 - 13 - 12 + 1 and {r["id"] for r in tables.read_buckets(spark, at, [3, 4]).collect()} == {500}
    assert len(tables.read_buckets(spark, at, [1]).inputFiles()) <= len(got.inputFiles()) // 4
    tables.write(rows.limit(0), at, "bucket")
    assert tables.read(spark, at)[1].count() == 0


# --- Delta ---


def random_defs(rng, files):
    return [(rng.choice(["functions", "classes"]), f"n{rng.randrange(60)}", f"f{f:03}.js", rng.randint(1, 50), rng.randrange(3)) for f in files for _ in range(rng.randint(0, 25))]


def test_delta_equals_a_full_rebuild(spark, tmp_path):
    rng, home = random.Random(3), str(tmp_path)
    defs = random_defs(rng, range(30))
    delta.build(spark.createDataFrame(defs, DEFS), home, 16)
    for step, changed in enumerate(([4], [0, 7, 29], [31], [])):
        gone = [f"f{f:03}.js" for f in changed]
        before = [d for d in defs if d[2] in gone]
        after = [] if step == 1 else random_defs(rng, changed) + [d for d in before if rng.random() < 0.5]
        defs = [d for d in defs if d[2] not in gone] + after
        args = (spark.createDataFrame([(g,) for g in gone], "file string"), spark.createDataFrame(before, DEFS), spark.createDataFrame(after, DEFS))
        n = delta.update(spark, home, *args, buckets=16)
        names = {d[:2] for d in before} | {d[:2] for d in after}
        assert n <= len(names)
        full = registry.registry(spark.createDataFrame(defs, DEFS))
        got = tables.read(spark, f"{home}/registry")[1].drop("bucket").select(*full.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, full.collect()))


def test_delta_touches_changed_names_only(spark, tmp_path):
    home = str(tmp_path)
    defs = [("functions", f"n{k}", f"f{k % 50}.js", k, 0) for k in range(500)]
    delta.build(spark.createDataFrame(defs, DEFS), home)
    before = [d for d in defs if d[2] == "f7.js"]
    after = before[:-1] + [("functions", "brand_new", "f7.js", 3, 0)]  # one name goes, one comes, nine stay
    pointer = lambda: tables._pointer(tables._Folder(spark, f"{home}/registry"))[1]["parts"]
    old = set(pointer())
    n = delta.update(spark, home, spark.createDataFrame([("f7.js",)], "file string"), spark.createDataFrame(before, DEFS), spark.createDataFrame(after, DEFS))
    assert n == 2 and len(set(pointer()) - old) <= 2  # at most two buckets were written


# --- Diffs ---

DIFF = """diff --git a/x.js b/x.js
--- a/x.js
+++ b/x.js
@@ -1,3 +1,4 @@
 one
-two
+TWO
+++ plus
 three
@@ -10 +11,2 @@ function f() {
 ten
+eleven
\\ No newline at end of file
diff --git a/gone.js b/gone.js
--- a/gone.js
+++ /dev/null
@@ -1 +0,0 @@
-x
--- a/new.js
+++ b/new.js
@@ -0,0 +1,2 @@
+n1
+n2"""


def test_added_lines(spark):
    got = [tuple(r) for r in diff.added(spark.createDataFrame([(DIFF,), (None,), ("no diff",)], "diff string")).orderBy("path", "line").collect()]
    assert got == [("new.js", 1, "n1"), ("new.js", 2, "n2"), ("x.js", 2, "TWO"), ("x.js", 3, "++ plus"), ("x.js", 12, "eleven")]


def test_intervals(spark):
    rows = spark.createDataFrame([("a", n) for n in (1, 2, 3, 3, 9, 200, 201)] + [("b", 5)], "path string, line int")
    spans = diff.intervals(rows)
    assert {tuple(r) for r in spans.collect()} == {("a", 1, 3), ("a", 9, 9), ("a", 200, 201), ("b", 5, 5)}
    every = spark.range(300).selectExpr("'a' path", "cast(id as int) line")
    assert [r["line"] for r in diff.within(every, spans).orderBy("line").collect()] == [1, 2, 3, 9, 200, 201]
    wide = spark.createDataFrame([("a", 10, 250)], "path string, first int, last int")
    assert diff.within(every, wide).count() == 241


# --- Engine ---


def test_engine_checks_added_lines_only(spark, tmp_path):
    src, home = tmp_path / "p", tmp_path / "home"
    put(src, {"src/a.js": "export function makeWidget() {}\n"})
    e = Engine(spark, str(home), "2024-01-10 00:00:00")
    e.reindex(str(src))
    content = "makeWidgt();\nmakeWidget();\nghostCall();\n"
    files = spark.createDataFrame([("src/n.js", content)], "path string, content string")
    third = "--- a/src/n.js\n+++ b/src/n.js\n@@ -1,2 +1,3 @@\n makeWidgt();\n makeWidget();\n+ghostCall();\n"
    second = "--- a/src/n.js\n+++ b/src/n.js\n@@ -1,2 +1,3 @@\n makeWidgt();\n+makeWidget();\n ghostCall();\n"
    one = lambda text: spark.createDataFrame([(text,)], "diff string")
    assert {(r["finding"], r["name"]) for r in e.references(files, one(third)).collect()} == {("unknown", "ghostCall")}
    assert e.blocked(files, one(second)) == 0


def test_engine_refreshes_by_delta(spark, tmp_path):
    src, home = tmp_path / "p", tmp_path / "home"
    put(src, {f"src/m{k}.js": f"export function made{k}() {{}}\nfunction shared() {{}}\nrouter.get('/api/r{k}', f)\n" for k in range(6)} | {"src/p.html": "<title>P</title>"})
    e = Engine(spark, str(home), "2024-01-10 00:00:00")
    first = e.reindex(str(src))
    assert first["files"] == 7 and "names_touched" not in first
    assert e.refresh(str(src))["names_touched"] == 0
    put(src, {"src/m3.js": "export function renamed() {}\n\nfunction shared() {}\n"})
    (src / "src/m5.js").unlink()
    put(src, {"src/new.py": "def fresh():\n    pass\n"})
    got = e.refresh(str(src))
    assert got["files"] == 7 and got["cache_hits"] == 5
    reg, files, routes = (sorted(map(str, e._table(t).drop("bucket").collect())) for t in ("registry", "files", "all_routes"))
    full = Engine(spark, str(tmp_path / "other"), "2024-01-10 00:00:00")
    full.reindex(str(src), full=True)
    assert [reg, files, routes] == [sorted(map(str, full._table(t).drop("bucket").collect())) for t in ("registry", "files", "all_routes")]


def test_check_report(spark, tmp_path):
    src, home = tmp_path / "p", tmp_path / "home"
    put(src, {"src/a.js": "export function makeWidget() {}\n", "src/b.js": "function makeWidget() {}\nclass Thing {}\n"})
    e = Engine(spark, str(home), "2024-01-10 00:00:00")
    e.reindex(str(src))
    text = e.check_report(["makeWidget", "makeWidgett", "ghostFn"], verbose=True)
    lines = text.split("\n")
    assert lines[0] == "Possible typos (1)" and lines[1].startswith("- makeWidgett -> makeWidget? (") and "src/a.js:1, defined in 2 files" in lines[1]
    assert lines[2] == "Unknown names (new, renamed or made up) (1)" and lines[3] == "- ghostFn" and lines[4].startswith("1 known, 1 near, 1 unknown")
    assert "Known names (1)" in lines and any(x.startswith("- makeWidget (functions, src/a.js:1") for x in lines)
    e.check(["ghostFn"]), e.check(["ghostFn"])
    assert "- ghostFn [reported 3 times]" in e.check_report(["ghostFn"])
    assert e.check_report(["Thing"]).startswith("All 1 names are in the registry (100% sure)")
    import json

    got = json.loads(e.check_report(["Thing", "ghostFn", "makeWidgett", "zz9"], form="json", record=False))
    assert got["unknown"] == ["ghostFn", "zz9"] and got["known"][0]["name"] == "Thing" and got["fuzzy"][0]["suggestion"] == "makeWidget"
    with pytest.raises(ValueError):
        e.check_report([])


# --- Watching ---


@pytest.fixture(scope="module")
def rocks(spark):
    for k, v in debounce.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in debounce.STATE_STORE:
        spark.conf.unset(k)


def test_tree_changes_across_a_restart(spark, tmp_path):
    src = tmp_path / "src"
    put(src, {"a.js": "x", "b/c.py": "y", "node_modules/n.js": "n", ".hid/h.js": "h", "note.txt": "t"})
    seen = []

    def poll():  # each poll is a query of its own, from the same checkpoint
        changes = tree_stream.tree_changes(spark, str(src), str(tmp_path / "state"), project="p")
        query = changes.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        query = query.foreachBatch(lambda df, _: seen.extend((r["project"], r["path"], r["change"]) for r in df.collect())).start()
        query.awaitTermination(120)
        out = sorted(seen)
        seen.clear()
        return out

    assert poll() == []
    put(src, {"a.js": "xx", "d/e/f.go": "z"})
    (src / "b/c.py").unlink()
    put(src, {"node_modules/n.js": "nn", "note.txt": "tt"})
    assert poll() == [("p", "a.js", "modified"), ("p", "b/c.py", "deleted"), ("p", "d/e/f.go", "added")]
    assert poll() == []
    put(src, {"b/c.py": "y"})
    assert poll() == [("p", "b/c.py", "added")]


def test_event_time_flushes_equal_the_batch(rocks, tmp_path):
    spark, rng, t0 = rocks, random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(f"p{rng.randrange(4)}", f"f{rng.randrange(9)}.js", t0 + dt.timedelta(seconds=rng.randrange(20_000))) for _ in range(300)]
    kind = "project string, path string, ts timestamp"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("end", "z.js", t0 + dt.timedelta(days=9))], kind).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = []
    query = debounce.flushes(stream, 60_000, "1 second").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    query = query.foreachBatch(lambda df, _: got.extend((r["project"], r["start"], r["end"], r["changes"], len(r["paths"])) for r in df.collect())).start()
    query.awaitTermination(200)
    want = analytics.debounced(spark.createDataFrame(rows, kind), "project", "60 seconds", "path").collect()
    assert sorted(got) == sorted(tuple(r) for r in want) and len(got) > 100


def wait(condition, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not condition():
        time.sleep(0.3)
    return condition()


def test_a_failed_flush_comes_again(rocks, tmp_path):
    spark = rocks
    src, seen, fails = tmp_path / "src", [], [True, True]
    put(src, {"a.js": "1"})

    def refresh(df):
        rows = [(r["attempt"], tuple(r["paths"])) for r in df.collect()]
        seen.extend(rows)
        if fails and fails.pop():
            raise RuntimeError("not yet")

    w = watch.Watcher(refresh, str(tmp_path / "watch"), gap_ms=300)
    w.start(tree_stream.tree_changes(spark, str(src), str(tmp_path / "state"), project="p"))
    try:
        assert wait(lambda: (tmp_path / "state" / "0.json").exists())
        put(src, {"a.js": "22", "b.js": "1"})
        assert wait(lambda: len(seen) >= 2), w.query.exception()
        assert seen[:2] == [(0, ("a.js", "b.js")), (1, ("a.js", "b.js"))]  # once more, and not a third time
        put(src, {"c.js": "1"})
        assert wait(lambda: w.scans >= 1), w.query.exception()
        outcomes = spark.read.parquet(str(tmp_path / "watch" / "outcomes"))
        assert wait(lambda: spark.read.schema(outcomes.schema).parquet(str(tmp_path / "watch" / "outcomes")).count() == 3)
        assert (0, ("c.js",)) in seen and w.failures == 2 and w.health()["active"] and not w.health()["recovery_pending"]
    finally:
        w.stop()
    out = spark.read.parquet(str(tmp_path / "watch" / "outcomes")).collect()
    assert sorted((r["flush"], r["attempt"], r["ok"]) for r in out) == [(0, 0, False), (0, 1, False), (1, 0, True)]


def test_engine_watches(rocks, tmp_path):
    src = tmp_path / "p"
    put(src, {"src/a.js": "function one() {}\n"})
    e = Engine(rocks, str(tmp_path / "home"), "2024-01-10 00:00:00")
    e.reindex(str(src))
    try:
        assert e.call("watch", str(src), debounce_ms=200)["active"]
        assert wait(lambda: list((tmp_path / "home" / "watch").glob("*/snapshots/0.json")))
        put(src, {"src/b.js": "function two() {}\n"})
        (src / "src/a.js").unlink()
        assert wait(lambda: e.watch_health(str(src))["scans"] >= 1), e._watchers[str(src)].query.exception()
        assert wait(lambda: {r["name"] for r in e._table("registry").collect()} == {"two"})
    finally:
        e.watch(str(src), enable=False)
    assert e.watch_health(str(src)) is None


def test_event_log_keeps_the_newest(rocks, tmp_path):
    spark, rng, t0 = rocks, random.Random(2), dt.datetime(2024, 1, 1)
    kind = "project string, symbol string, file string, type string, ts timestamp, seq long"
    rows = [(rng.choice("pq"), f"s{k}", "", "unknown", t0 + dt.timedelta(seconds=k // 3), k) for k in range(400)]
    for n in range(4):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    last = {}
    query = debounce.event_log(stream, 50).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)

    def keep(df, _):
        fresh = {}
        for r in df.collect():
            fresh.setdefault(r["project"], []).append((r["seq"], r["symbol"]))
        last.update(fresh)

    query.foreachBatch(keep).start().awaitTermination(200)
    for p in "pq":
        own = [r[1] for r in rows if r[0] == p]
        assert sorted(last[p]) == list(zip(range(len(own) - 49, len(own) + 1), own[-50:]))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from symbolith import __main__ as cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    src, home = tmp_path / "p", str(tmp_path / "home")
    put(src, {"src/a.js": "export function makeWidget() {}\n", "n.md": "text ghost()\n```js\nghostCall();\n```\n", "c.json": '{"mcpServers": {"git-a": {}, "git-long": {}}}'})
    assert cli.main([home]) == 2 and cli.main([home, "nothing"]) == 2
    assert cli.main([home, "index", str(src)]) == 0
    assert cli.main([home, "check", "makeWidget"]) == 0 and "All 1 names are in the registry" in capsys.readouterr().out
    assert cli.main([home, "references", str(src / "n.md")]) == 2 and "unknown: ghostCall" in capsys.readouterr().err
    assert cli.main([home, "setup", str(src / "c.json"), "--profile", "git=git"]) == 0
    out = capsys.readouterr().out
    assert "git-long" in out and "redundant" in out
