"""Reports of captured outputs, as relations of lines; extraction rules and depths."""

import time

import pytest
from pyspark.sql import functions as F

from symbolith.operators import check, condense, extract, report, reports, rules


def made(spark, f, *texts):
    lines = condense.explode_lines(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t")
    rows = {r["doc"]: r["out"] for r in f(lines).collect()}
    assert len(rows) == len(texts)
    return [rows[k] for k in range(len(texts))]


def test_test_reports(spark):
    long = "✖ long\n" + "\n".join(f"  line {k}" for k in range(20)) + "\nFAILED late\n"
    node, go, jest, none, many, mixed, py, capped = made(
        spark, reports.tests, "✔ a\n✖ b (4ms)\n  Error: x\nℹ tests 3\nℹ pass 2\nℹ fail 1\n", "ok pkg/a 0.1s\nFAIL pkg/b 0.2s\n", "Tests: 2 failed, 18 passed, 20 total", "  \n",
        "\n".join(f"test t{k} ... FAILED" for k in range(7)) + "\nerror[E1]: x\nERR! y\nError z\nError w", "a\nb\nc\nd\ne\nf\n\n", "FAILED t1\nE   assert 1\n  ctx\ndone\nE   other\n1 passed, 2 failed, 3 skipped", long,
    )
    assert node == "3 tests: 1 failed, 2 passed\nFAILURES:\n✖ b (4ms)\nError: x"
    assert go == "2 tests: 1 failed, 1 passed\nFAILURES:\nFAIL pkg/b" and jest == "20 tests: 2 failed, 18 passed" and none == "no output"
    assert many.split("\n")[6:] == ["... +2 more failures", "ERRORS:", "error[E1]: x", "ERR! y", "Error z"]
    assert mixed == "b\nc\nd\ne\nf"
    assert py == "6 tests: 2 failed, 1 passed, 3 skipped\nFAILURES:\nFAILED t1\nE   assert 1\nctx\nE   other"
    assert capped == "FAILURES:\n✖ long\n" + "\n".join(f"line {k}" for k in range(9)) + "\nFAILED late"


def test_lint_log_and_build_reports(spark):
    tsc, none, empty = made(spark, reports.lint, "a.ts(1,2): error TS1: m\nb.ts(1,2): error TS1: m\nc.ts(1,1): warning TS2: n\n", "\n".join(f"line {k}" for k in range(17)), "")
    assert tsc == "2 errors, 1 warnings (2 unique rules)\n\n  TS1: m (×2 in 2 files)\n  TS2: n (×1 in 1 file)"
    assert none.endswith("line 14\n... +2 more lines") and empty == "no errors"
    log, blank = made(spark, reports.logs, "2024-01-01 10:00:00 a\n2024-01-01 10:00:01 a\nb 10.0.0.1\nb 10.0.0.2\n", "\n")
    assert log.splitlines() == ["4 lines → 2 unique (2 duplicates collapsed)", "2024-01-01 10:00:00 a (×2)", "b 10.0.0.1 (×2)"] and blank == "no output"
    build, quiet = made(spark, reports.builds, "step\nx: error: y\nx: error: y\nwarning: z\n", "a\nb\nc\nd\ne")
    assert build.splitlines() == ["2 error line(s) (1 unique):", "x: error: y", "1 warning line(s):", "warning: z"] and quiet == "b\nc\nd\ne"


def test_condense_takes_reports_of_lines(spark):
    raw = "\n".join(["x: error: y"] * 40 + ["step"] * 40)
    rows = spark.createDataFrame([(1, "make", raw), (2, "make", raw), (3, "npm test", "✔ ok\n" * 60 + "3 passed, 1 failed"), (4, "make", None), (5, "docker logs w", "a b\n" * 90)], "id int, command string, raw string")
    got = {r["id"]: r["condensed"]["output"] for r in condense.condense(rows).collect()}
    assert got == {1: "40 error line(s) (1 unique):\nx: error: y", 2: got[1], 3: "4 tests: 1 failed, 3 passed", 4: "", 5: "90 lines → 1 unique (89 duplicates collapsed)\na b (×90)"}


@pytest.mark.parametrize("size", [100_000])
def test_rules_are_linear(spark, size):
    parts = ["case " + ",".join(map(str, range(size // 6))) + " -> run();", "a " * (size // 2), "a,", "(", ")", " ", "<", "static ", "@a ", "const a = (", "pub ", "create ", "x", "::", "a::", "function ", "class ", "{", "'", "\\'"]
    texts = [p if len(p) > 20 else p * (size // len(p)) for p in parts] + ["int f(" + "a, " * (size // 3) + ")" * 50, "public Map<" + "A<" * (size // 2)]
    langs = [*rules.RULES, "javascript"]
    rows = spark.createDataFrame([(f"{k}", lang, 1, t) for k, t in enumerate(texts) for lang in langs], "file string, lang string, line int, text string")
    extract.by_rules(rows.where("length(text) < 9"), fallback=True).count()
    began = time.time()
    extract.by_rules(rows, fallback=True).count()
    assert time.time() - began < 0.2 * len(rows.collect())


def test_outer_definitions_by_depth(spark):
    go = 'func a() {\nfunc inner() {}\ns := "}" // }\nr := \'}\'\n}\nfunc b() {\n}\n}\nfunc c() {}\ntype T struct {'
    rows = spark.createDataFrame([("x.go", "go", go)], "path string, lang string, content string")
    names = lambda nested: {r["name"] for r in extract.definitions(rows, nested).collect()}
    assert names(True) == {"a", "inner", "b", "c", "T"} and names(False) == {"a", "b", "c", "T"}


def test_python_by_its_parser(spark):
    rows = spark.createDataFrame([("a.py", "python", "MAX = 1\nclass A:\n    def _m(self):\n        def inner(): pass\n"), ("b.py", "python", "def ok():\n  (((")], "path string, lang string, content string")
    got = lambda **kw: {(r["file"], r["name"]) for r in extract.definitions(rows, **kw).collect()}
    assert got(parsers=("python",)) == {("a.py", "MAX"), ("a.py", "A"), ("a.py", "_m"), ("a.py", "inner"), ("b.py", "ok")}
    assert got() == {("a.py", "MAX"), ("a.py", "A"), ("a.py", "inner"), ("b.py", "ok")}


def test_containing(spark):
    parts = spark.createDataFrame([("ab",), ("users",), ("a",), ("",), ("zz",), ("apiusers1",)], "s string")
    wholes = spark.createDataFrame([("apiusers",), ("apiusers1x",), ("cab",), ("",)], "m string")
    got = {(r["s"], r["m"]) for r in report.containing(parts, wholes, "s", "m").collect()}
    assert got == {("ab", "cab"), ("users", "apiusers"), ("users", "apiusers1x"), ("a", "apiusers"), ("a", "apiusers1x"), ("a", "cab"), ("apiusers1", "apiusers1x")}
    plan = report.containing(parts, wholes, "s", "m")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_deletions(spark):
    rows = check.deletions(spark.createDataFrame([("abcd",), ("a",), ("aab",)], "w string"), "w", F.lit(2))
    left = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} for w in ("abcd", "a", "aab")}
    for w, one in left.items():
        want = {w} | one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}
        hashes = {r[0] for r in spark.createDataFrame([(x,) for x in want], "x string").select(F.xxhash64("x")).collect()}
        assert {r["rest"] for r in rows.where(F.col("w") == w).collect()} == hashes
