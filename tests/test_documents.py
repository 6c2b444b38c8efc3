"""Functions of one text, without Spark."""

from symbolith.functions import documents as D
from symbolith.operators import js

STATUS = "On branch main\nChanges to be committed:\n\tmodified:   a.js\n\tnew file:   b.js\n\tdeleted:    c.js\n\nChanges not staged for commit:\n\tmodified:   d.md\n\nUntracked files:\n" + "".join(f"\tu{i}\n" for i in range(7))


def test_runs_of_lines():
    assert D.collapse_runs("a\na\na\na\na") == ("a [×5]", 4)
    assert D.collapse_runs("a\na") == ("a\na", 0)
    assert D.collapse_runs("x\nx\nx\nx\ny\nz\nz\nz") == ("x [×4]\ny\nz [×3]", 5)
    assert D.collapse_runs("") == ("", 0)


def test_similar_lines():
    text = "npm warn deprecated a\nnpm warn deprecated b\nnpm warn deprecated c\nnpm warn deprecated d\nend"
    assert D.group_similar(text) == ("npm warn deprecated: a, b, c, d (4 items)\nend", 1)
    assert D.group_similar("a b\nc d\ne f") == ("a b\nc d\ne f", 0)
    # a run that is too short gives up its anchor only: the next line may start a longer one
    assert D.group_similar("x 1\nx 2\nxy 3\nxy 4")[1] == 1


def test_status_and_log():
    out, saved = D.git_status(STATUS)
    assert "staged (3)" in out and "modified (1)" in out and "untracked (7): u0, u1, u2, u3, u4 +2 more" in out and saved > 30
    assert D.git_status("") == ("clean working tree", 100)
    assert D.git_log("commit abcdef1234\nAuthor: x\n\n    hi\n    more\n")[0] == "1 commits\nabcdef1 hi"
    assert D.git_log("abcdef1 one\nbcdef12 two")[0] == "2 commits\nabcdef1 one\nbcdef12 two"
    assert D.git_diff("index abc..def 100\n+a\n", [])[0] == "+a"
    assert D.git("pushed\nmain -> origin/main\n", ["push"])[0] == "ok origin/main"
    assert D.git("3 files changed, 2 insertions(+)", ["pull"])[0] == "ok 3 files +2"
    assert D.git("x", ["stash"]) is None


def test_files_and_json():
    assert D.dir_listing("total 3\ndrwxr-xr-x 2 u g 4 Jan 1 10:00 src\n-rw-r--r-- 1 u g 4 Jan 1 10:00 a.js")[0] == "1 dirs, 1 files\n📁 src/\n  a.js"
    assert D.file_content("// c\nx = 1\n\n/* a\nb */\ny")[0] == "x = 1\ny"
    assert D.file_content("function f() {\n  a\n}\nb", "aggressive")[0] == "function f() {\nb"
    assert D.json_report('{"a": [1, 2], "b": "x"}')[0] == '{2 keys}\n  a: [1, ... (2 items)]\n  b: "x"'
    assert D.json_report("[]")[0] == "[] (empty array)"
    assert D.json_report("not json") == ("not json", 0)
    assert D.shape({"a": {"b": {"c": {"d": 1}}}}) == "{ a: { b: { c: { d: ... } } } }"


def test_generic():
    assert "24.12.0" in D.generic("24.12.0\n 45% done\n#####\n")[0]
    out, saved = D.truncate("x" * 4000)
    assert "omitted" in out and saved > 45 and len(out) // 4 <= 510
    assert D.generic("") == ("", 0)


def test_rename_only_in_code():
    assert D.rename("foo(a) // foo\n'foo' + foo2 + foo + `foo`", "foo", "bar") == "bar(a) // foo\n'foo' + foo2 + bar + `foo`"


def test_javascript():
    found = js.symbols("export const a = () => 1;\nclass B { constructor() {} m(x) {} async n() {} }\nexport { a as c };\nlet { p, q: r } = o;")[0]
    names = {(c, n) for c, n, _, _ in found}
    assert names == {("functions", "a"), ("classes", "B"), ("functions", "m"), ("functions", "n"), ("exports", "a"), ("variables", "p"), ("variables", "r")}
    assert js.symbols("function ( {") == ([], False)
    assert js.symbols("const r = /[}\"]/; function ok() {}")[0][-1][1] in ("ok", "r")
    assert ("method", "B", "m(x)", 1) in js.skeleton("class B { m(x) { return 1 } }")


def test_long_strings_and_spaces(spark):
    """100,000 quoted characters don't exhaust the stack, 100,000 spaces don't take quadratic time."""
    from symbolith.functions import text as T

    quoted = "a('" + "x\\'" * 50_000 + "');"
    rows = spark.createDataFrame([(quoted, "a" + " " * 100_000 + "b" + " " * 100_000)], "code string, text string")
    r = rows.select(T.strip_comments_and_strings(rows["code"]).alias("code"), T.normalize_whitespace(rows["text"]).alias("text"), T.trim(rows["text"]).alias("bare")).first()
    assert r["code"] == "a('');" and r["text"] == r["bare"] == "a" + " " * 100_000 + "b"
