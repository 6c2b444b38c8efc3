"""Reports of captured outputs that Spark makes of the words of ``documents``.

Each line of a text that has a word becomes a line of output about that word, its form taken from a list in turn. The SQL
knows what each form means; the queries see only the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.operators import condense, reports

from .base import Catalog, table

_c = Catalog()
QUERIES, ORACLE = _c.queries, _c.oracle
WORD = "[a-z]{3,}"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, pos, w): the first word of each line that has one, numbered from 0."""
    found = F.filter(F.transform(F.split("text", "\n", -1), lambda t: F.regexp_extract(t, WORD, 0)), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(found).alias("pos", "w"))


WORDS = f"""found AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda t: regexp_extract(t, '{WORD}')), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT doc_id, source, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM found)"""


def filled(forms: list[str]) -> F.Column:
    """The form of a row's place with its word for ``{w}`` and hashes of the word for ``{h}`` and ``{g}``."""
    form = F.get(F.array(*map(F.lit, forms)), (F.col("pos") % len(forms)).cast("int"))
    for mark, value in (("{w}", F.col("w")), ("{h}", F.md5("w")), ("{g}", F.md5(F.concat("w", F.lit("-"))))):
        form = F.replace(form, F.lit(mark), value)
    return form


def output(spark: SparkSession, sf_dir: str, forms: list[str]) -> DataFrame:
    """(doc, line_no, text) of outputs with lines of these forms in turn."""
    return words(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("pos").alias("line_no"), filled(forms).alias("text"))


LINT = [
    "src/{w}.ts(3,5): error TS2322: Type {w} is wrong", "/work/src/{w}.js", "  12:5  error  {w} is not defined  no-undef", "{w}.py:1:1: F401 {w} imported but unused",
    "error[E0382]: use of moved {w}", "Warning: deprecated {w}", "plain {w} text", "  {w}.c:9:1: warning: unused {w} [unused]",
]


@_c.query(f"""WITH {WORDS}, l AS (SELECT doc_id AS doc, pos, pos % 8 AS k, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS above FROM words),
d AS (SELECT doc, pos, CASE k WHEN 0 THEN 'TS2322: Type ' || w || ' is wrong' WHEN 2 THEN 'no-undef: ' || w || ' is not defined' WHEN 3 THEN 'F401: ' || w || ' imported but unused'
  WHEN 4 THEN 'E0382: use of moved ' || w WHEN 5 THEN 'deprecated ' || w END AS rule,
  CASE k WHEN 0 THEN 'src/' || w || '.ts' WHEN 2 THEN '/work/src/' || above || '.js' WHEN 3 THEN w || '.py' END AS file, k <> 5 AS is_error FROM l WHERE k IN (0, 2, 3, 4, 5))
SELECT doc, rule, count(*) AS n, count(DISTINCT file) AS files, count(*) FILTER (is_error) AS errors, count(*) FILTER (NOT is_error) AS warnings, CAST(min(pos) AS INT) AS line_no FROM d GROUP BY doc, rule""")
def lint_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lint_rules(output(spark, sf_dir, LINT))


BUILD = ["[1/3] compiling {w}", "src/{w}.c:3: error: missing ;", "src/{w}.h:9: warning: unused", "WARN cache of {w} is cold", "✖ {w} failed", "no errors in {w}"]


@_c.query(f"""WITH {WORDS}, l AS (SELECT doc_id AS doc, pos, pos % 6 AS k, w FROM words WHERE pos % 6 BETWEEN 1 AND 4)
SELECT doc, CASE WHEN k IN (1, 4) THEN 'error' ELSE 'warning' END AS kind,
  CASE k WHEN 1 THEN 'src/' || w || '.c:3: error: missing ;' WHEN 2 THEN 'src/' || w || '.h:9: warning: unused' WHEN 3 THEN 'WARN cache of ' || w || ' is cold' ELSE '✖ ' || w || ' failed' END AS text,
  count(*) AS n, CAST(min(pos) AS INT) AS line_no FROM l GROUP BY ALL""")
def build_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.build_lines(output(spark, sf_dir, BUILD))


STATUS = [
    "Changes to be committed:", "\tmodified:   {w}.js", '  (use "git restore --staged <file>..." to unstage)', "Changes not staged for commit:", "\tdeleted:    {w}.txt", "Untracked files:", "\t{w}.md", "",
]


@_c.query(f"""WITH {WORDS} SELECT doc_id AS doc, CAST(pos AS INT) AS line_no, CASE pos % 8 WHEN 1 THEN 'staged' WHEN 4 THEN 'modified' ELSE 'untracked' END AS section,
  CASE pos % 8 WHEN 1 THEN 'modified: ' || w || '.js' WHEN 4 THEN 'deleted: ' || w || '.txt' ELSE w || '.md' END AS entry FROM words WHERE pos % 8 IN (1, 4, 6)""")
def git_status_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condense.status_entries(output(spark, sf_dir, STATUS))


LOG = ["commit {h}", "Author: {w} <a@b.c>", "Date:   Mon Jan 1", "", "    About {w}", "    more {w}"]


@_c.query(f"""WITH {WORDS}, l AS (SELECT doc_id AS doc, pos // 6 AS block, pos % 6 AS k, w FROM words)
SELECT doc, CAST(block + 1 AS INT) AS block, left(md5(max(w) FILTER (k = 0)), 7) AS hash, coalesce('About ' || max(w) FILTER (k = 4), '') AS message FROM l GROUP BY doc, block""")
def git_log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condense.log_commits(output(spark, sf_dir, LOG))


#: Commands and what they are.
COMMANDS = [
    ("git status {w}", "git"), ("NODE_ENV={w} npm test", "test"), ("npm run test {w}", "test"), ("pytest -q {w}.py", "test"), ("cargo clippy --{w}", "lint"), ("ls -la {w}", "file"), ("cat {w}.js", "file"),
    ("kubectl get {w} -o json", "json"), ("tail -f {w}.log", "log"), ("docker logs {w}", "log"), ("docker build {w}", "build"), ("npm run build", "build"), ("npm install {w}", "package"), ("pip install {w}", "package"),
    ("x{w} --x", "unknown"), ("go test ./{w}", "test"), ("A={w} B=2 make", "build"), ("yarn test {w}", "test"), ("jq .{w}", "json"), ("vite build {w}", "build"), ("", "unknown"),
]


@_c.query(f"""WITH {WORDS}, c(k, command, category) AS (VALUES {", ".join(f"({k}, '{c}', '{w}')" for k, (c, w) in enumerate(COMMANDS))})
SELECT doc_id AS doc, CAST(pos AS INT) AS line_no, replace(command, '{{w}}', w) AS command, category FROM words JOIN c ON pos % {len(COMMANDS)} = k""")
def command_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = output(spark, sf_dir, [c for c, _ in COMMANDS]).withColumnRenamed("text", "command")
    return rows.withColumn("category", condense.command_category(F.col("command")))


TESTS = ["✖ {w}", "  at {w}", "    in {w}", "✔ {w}", "test {w} ... FAILED", "Error: {w}", "ok {w}/pkg 0.1s", "3 passed, 1 failed"]


@_c.query(f"""WITH {WORDS}, l AS (SELECT doc_id AS doc, pos, pos % 8 AS k, pos // 8 AS turn, w FROM words),
s AS (SELECT doc, max(pos) FILTER (k = 7) AS said FROM l GROUP BY doc),
c AS (SELECT doc, any_value(said) AS said, count(*) FILTER (k = 6 AND pos > coalesce(said, -1)) AS later FROM l JOIN s USING (doc) GROUP BY doc),
f AS (SELECT doc, min(pos) AS pos, string_agg(CASE k WHEN 0 THEN '✖ ' || w WHEN 1 THEN 'at ' || w ELSE 'in ' || w END, chr(10) ORDER BY pos) AS failure FROM l WHERE k < 3 GROUP BY doc, turn
  UNION ALL SELECT doc, pos, 'test ' || w || ' ... FAILED' FROM l WHERE k = 4),
n AS (SELECT doc, count(*) AS failures FROM f GROUP BY doc),
p AS (SELECT doc, 0 AS part, 0 AS pos, CASE WHEN said IS NULL THEN later || ' tests: ' || later || ' passed' ELSE (4 + later) || ' tests: 1 failed, ' || (3 + later) || ' passed' END AS line FROM c WHERE said IS NOT NULL OR later > 0
  UNION ALL SELECT doc, 1, 0, 'FAILURES:' FROM n
  UNION ALL SELECT doc, 2, pos, failure FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS r FROM f) WHERE r <= 5
  UNION ALL SELECT doc, 3, 0, '... +' || (failures - 5) || ' more failures' FROM n WHERE failures > 5
  UNION ALL SELECT DISTINCT doc, 4, 0, 'ERRORS:' FROM l WHERE k = 5
  UNION ALL SELECT doc, 5, pos, 'Error: ' || w FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS r FROM l WHERE k = 5) WHERE r <= 3)
SELECT doc, string_agg(line, chr(10) ORDER BY part, pos) AS report FROM p GROUP BY doc""")
def test_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tests(output(spark, sf_dir, TESTS)).select("doc", F.col("out").alias("report"))


@_c.query()
def compress_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as outputs of commands of all categories, in turn by their ids."""
    commands = ["tail x.log", "npm test", "npx eslint .", "make", "git log", "git diff", "git status", "cat a.js", "ls -la", "tree", "jq .", "unknown"]
    command = F.get(F.array(*map(F.lit, commands)), (F.col("doc_id") % len(commands)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", command.alias("command"), F.col("text").alias("raw"))
    return condense.condense(rows).select("doc_id", "category", "redacted_count", "condensed.*")
