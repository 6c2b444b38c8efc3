"""Registry, verdicts, references and extraction on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.operators import analytics, check, condense, extract, references, registry, report


def known_of(spark, rows):
    return spark.createDataFrame(
        [(n, 1, f, ln, 0, c, u, "root") for n, c, f, ln, u in rows],
        "name string, cat_rank int, file string, line int, pass int, category string, usages long, namespace string",
    )


def verdict(spark, names, queries):
    known = known_of(spark, [(n, "functions", "a.js", i, 1) for i, n in enumerate(names)])
    q = spark.createDataFrame(list(enumerate(queries)), "ord int, q string")
    return {r["q"]: (r["verdict"], r["match"]) for r in check.verdicts(q, known).collect()}


def test_verdicts(spark):
    assert verdict(spark, ["abc"], ["ab"])["ab"][0] == "unknown"
    got = verdict(spark, ["food"], ["food", "foud", "fuud"])
    assert [got[x][0] for x in ("food", "foud", "fuud")] == ["known", "fuzzy", "unknown"]
    assert verdict(spark, ["calculateTotal"], ["calculateTotle"])["calculateTotle"] == ("fuzzy", "calculateTotal")
    assert verdict(spark, ["Foo"], ["fOO"])["fOO"][0] == "fuzzy"


def test_summary_keeps_repeats(spark):
    known = known_of(spark, [("foo", "functions", "a", 1, 7)])
    q = spark.createDataFrame([("foo",), ("foo",), ("zzzzzz",)], "q string")
    checked = check.verdicts(q, known)
    assert check.summary(checked).first().asDict() == {"queried": 3, "known": 2, "fuzzy": 0, "unknown": 1, "overall_confidence_pct": 67}
    assert all(r["established"] for r in checked.where("verdict = 'known'").collect())


def test_block_join_equals_nested_loop(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB") for _ in range(rng.randint(1, 14)))
    known = known_of(spark, [(n, "functions", "f", i, 1) for i, n in enumerate({word() for _ in range(150)})])
    q = spark.createDataFrame([(w,) for w in {word() for _ in range(80)}], "q string")
    fast, slow = check.fuzzy(q, known, True), check.fuzzy(q, known, False)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    names = known.select("name", F.col("name").alias("ord"))
    assert sorted(map(tuple, check.typos(q, names, True).collect())) == sorted(map(tuple, check.typos(q, names, False).collect()))


def test_registry_places(spark):
    defs = spark.createDataFrame(
        [("functions", "shared", f"src/{x}.js", 3, 0) for x in "gfedcba"] + [("functions", "solo", "a.js", 1, 0)] * 2, "category string, name string, file string, line int, pass int"
    )
    reg = {r["name"]: r for r in registry.registry(defs).collect()}
    assert reg["shared"]["usages"] == 7 and reg["shared"]["file"] == "src/a.js" and len(reg["shared"]["locations"]) == 5
    assert reg["solo"]["usages"] == 2 and reg["solo"]["locations"] is None and reg["solo"]["namespace"] == "root"


def test_rules_by_language(spark):
    code = {
        "a.sql": ("CREATE TABLE IF NOT EXISTS t1 (\nCREATE VIEW v AS\ncreate function f1()", {("classes", "t1"), ("functions", "f1")}),
        "a.yaml": ("key: 1\n  inner: 2", {("variables", "key")}),
        "a.sh": ("# f()\nrun() {\nfunction go {\nif (x)", {("functions", "run"), ("functions", "go")}),
        "a.py": ("MAX: int = 1\nmin = 2\ndef _p():\n    def _q():", {("variables", "MAX"), ("functions", "_p")}),
        "a.md": ("# def x():", set()),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in code.items()], "path string, content string").withColumn("lang", extract.language(F.col("path")))
    got = {}
    for r in extract.definitions(rows).collect():
        got.setdefault(r["file"], set()).add((r["category"], r["name"]))
    assert got == {k: v[1] for k, v in code.items() if v[1]}


def test_broken_script_falls_back(spark):
    rows = spark.createDataFrame([("a.js", "function ok() {\nconst f = (x) => {{{")], "path string, content string").withColumn("lang", F.lit("javascript"))
    assert {r["name"] for r in extract.javascript(rows).collect()} == {"ok", "f"}


def test_inline_script_lines(spark):
    html = "<html>\n<title> T </title>\n<script>\nfunction inPage() {}\n</script><script src='x.js'></script><script src='https://c/d.js'></script>"
    rows = spark.createDataFrame([("d/p.html", html)], "path string, content string")
    assert [(r["name"], r["line"]) for r in extract.page_scripts(rows).collect()] == [("inPage", 4)]
    page = extract.pages(rows).first()
    assert (page["page"], page["title"], page["scripts"]) == ("p.html", "T", ["x.js"])


@pytest.mark.parametrize("path,ns", [("a.js", "root"), ("src/a.js", "src"), ("apps/web/a.js", "apps/web"), ("services\\x\\y", "services/x")])
def test_namespace(spark, path, ns):
    assert spark.createDataFrame([(path,)], "p string").select(T.namespace(F.col("p"))).first()[0] == ns


def test_routes(spark):
    routes = spark.createDataFrame([("GET", "/api/a/:id"), ("GET", "/api/b"), ("MOUNT", "/api/m"), ("MOUNT", "/api/b")], "method string, path string")
    lits = spark.createDataFrame([("/api/a/7",), ("/api/a",), ("/api/b/",), ("/api/m/x",), ("/api/b/x",), ("/api/zz",)], "literal string")
    assert {r[0] for r in references.bad_routes(lits, routes).collect()} == {"/api/b/x", "/api/zz"}
    assert references.bad_routes(lits, routes.limit(0)).count() == 0


def test_fences_and_resolution(spark):
    md = "x\n```js\na()\n```\n```py\nb\n```\n```ts\nc()\n```"
    assert spark.createDataFrame([(md,)], "m string").select(references.fences(F.col("m"))).first()[0] == "a()\n\nc()\n"
    row = spark.createDataFrame([("a/b/c.js", "../d/./e")], "p string, r string").select(references.resolve(F.col("p"), F.col("r"))).first()
    assert row[0] == "a/d/e"


def test_event_log_limits(spark):
    rows = [("s%d" % (i % 3), "f", "unknown", i) for i in range(505)]
    ev = spark.createDataFrame(rows, "symbol string, file string, type string, seq long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    newest = analytics.newest(ev)
    assert newest.count() == 500 and newest.agg(F.min("seq")).first()[0] == 5
    assert analytics.frequent(ev.limit(2)).count() == 0
    assert analytics.watchlist(ev).count() == 3


def test_condense_chain(spark):
    rows = [
        ("git status", "On branch x\nUntracked files:\n\ta\n"),
        ("unknown-cmd", "\n".join(f"line {i} of the long output" for i in range(300))),
        ("node --version", "24.12.0\n"),
        ("x", "key sk-" + "a" * 48),
        ("npm test", None),
    ]
    out = {r["command"]: r for r in condense.condense(spark.createDataFrame(rows, "command string, raw string")).collect()}
    assert out["git status"]["category"] == "git" and out["git status"]["condensed"]["output"] == "untracked (1): a"
    assert out["unknown-cmd"]["condensed"]["compressed_tokens"] <= 510 and out["unknown-cmd"]["condensed"]["savings_percent"] > 50
    assert out["node --version"]["condensed"]["output"] == "24.12.0"
    assert out["x"]["redacted_count"] == 1 and "[REDACTED:OPENAI_KEY]" in out["x"]["condensed"]["output"]
    assert out["npm test"]["condensed"]["original_chars"] == 0


def test_tree_stops_at_the_limit(spark):
    files = spark.createDataFrame([(f"d{i}/f{j}",) for i in range(3) for j in range(4)], "path string")
    assert [tuple(r) for r in report.tree(files, 6).orderBy("dir").collect()] == [("d0", 4, 4, False), ("d1", 4, 2, True)]


def test_tallies_of_repeated_and_nameless_files_equal_rows_counted_by_key(spark, monkeypatch):
    monkeypatch.setattr(registry, "PIECE", 16)
    texts = [("b/2", "abc Def\nabc"), ("a/1", "xyz\n\nabc abc"), ("b/2", "Def abc"), (None, "abc"), ("c/3", None), ("c/4", ""), ("d/5", "abc Xyz abc\nxyz")]
    files = spark.createDataFrame(texts, "file string, text string")
    pattern, kind = "[A-Za-z_][A-Za-z0-9_]{2,}", F.when(F.col("name").rlike("^[A-Z]"), "classes").otherwise("functions")
    lines = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "t"))
    defs = lines.select("file", (F.col("at") + 1).alias("line"), F.posexplode(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("pass", "name")).withColumn("category", kind)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(registry.entries_of(registry.tallies(files, pattern), kind), registry.entries(defs))
    named, own = files.where("file is not null"), defs.where("file is not null")
    assert same(registry.locations_of(registry.tallies(named, pattern, 2), kind, 2), registry.locations(registry.per_file(own), 2))


def test_tallies_move_a_common_name_once_for_many_files(spark):
    files = spark.range(500).select(F.format_string("a/%03d", "id").alias("file"), F.lit("abc Def").alias("text")).coalesce(1)
    assert registry.tallies(files, "[A-Za-z]{3,}").count() == 2
    assert registry.tallies(files, "[A-Za-z]{3,}", 5).count() == 10


def test_segments_meet_few_places_of_a_name(spark):
    """Long names of which none is near: a query's segments aren't tried at all places within k."""
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(12)) for _ in range(150)]
    names = spark.createDataFrame([(w, w) for w in words[:100]], "name string, nkey string")
    queries = spark.createDataFrame([(w, w, 3) for w in words[50:]], "q string, qkey string, k int")
    pairs = check.block_candidates(queries, names)
    found = pairs.where("levenshtein(qkey, nkey) <= k").select("q", "name").distinct().count()
    every = queries.crossJoin(names).where("levenshtein(qkey, nkey) <= k").select("q", "name").distinct().count()
    assert found == every and pairs.count() < 0.9 * queries.select("q").distinct().crossJoin(names.select("name").distinct()).count()
