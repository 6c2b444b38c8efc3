"""Reports of captured outputs from relations of lines (doc, line_no, text): tests, diagnostics, logs, builds.

Each gives (doc, out). What a report shows is chosen by ranks over a document's lines, so only the few rows that are shown are
gathered. Counts are aggregates over all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.session import materialize

NOTHING = "no output"


def _joined(rows: DataFrame) -> DataFrame:
    """(doc, out) of the lines (doc, part, ord, text) that a report shows, in order."""
    listed = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("part", "ord", "text"))).alias("x"))
    return listed.select("doc", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("out"))


def _line(doc_rows: DataFrame, part: int, text: Column, ord_: Column | int = 0) -> DataFrame:
    order = ord_ if isinstance(ord_, Column) else F.lit(ord_)
    return doc_rows.select("doc", F.lit(part).alias("part"), order.cast("long").alias("ord"), text.alias("text")).where("text is not null")


def _first(rows: DataFrame, shown: int, *order: Column) -> DataFrame:
    """The first ``shown`` rows of a document, with their rank and how many there are."""
    w = Window.partitionBy("doc")
    ranked = rows.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "all": F.count("*").over(w)})
    return ranked.where(F.col("rank") <= shown)


def _more(shown: DataFrame, limit: int, what: str, part: int, indent: str = "") -> DataFrame:
    """A line that says how many rows aren't shown."""
    over = shown.where((F.col("rank") == limit) & (F.col("all") > limit))
    return _line(over, part, F.format_string(f"{indent}... +%d more {what}", F.col("all") - limit))


def _otherwise(lines: DataFrame, report: DataFrame, shown: int, last: bool, empty: str, note: str | None = None) -> DataFrame:
    """``report``, and for documents without one some of their visible lines, or ``empty`` where none is visible."""
    report = materialize(report)
    rest = materialize(lines.join(report.select("doc"), "doc", "left_anti"))
    if rest.isEmpty():
        return report
    visible = rest.where(F.col("text").rlike(r"\S")).withColumn("text", F.col("text") if not last else T.trim(F.col("text")))
    order = F.col("line_no").desc() if last else F.col("line_no")
    some = _first(visible, shown, order)
    parts = _line(some, 0, F.col("text"), F.col("line_no"))
    parts = parts.unionByName(_more(some, shown, note, 1)) if note else parts
    blank = rest.groupBy("doc").agg(F.max(F.col("text").rlike(r"\S")).alias("v")).where("not v").select("doc", F.lit(empty).alias("out"))
    return report.unionByName(_joined(parts)).unionByName(blank)


# --- Tests -------------------------------------------------------------------

# Words that test runners count with, and those of the protocol that puts them before the number.
COUNTED = ("total", "passed", "failed", "skipped")
NAMED_BEFORE = {"total": "tests", "passed": "pass", "failed": "fail"}
#: What a line of a test report is, by its text without white space around it; the first that fits.
KINDS = (
    ("package", r"^(?:ok|FAIL)\s+\S+\s"),
    ("mark", r"^(?:[●✕✖]|FAIL )"),
    ("more", r"^(?:FAILED|E\s)"),
    ("solo", r"(?i)^test\s.+\.\.\.\s+FAILED"),
)
ERROR = r"(?i)^(?:error|err!)"


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def test_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with what each is: kind, counters that it states, its failure (``block``) and its rank in it.

    A failure is an island: it starts at a mark, or at a line that goes on with none open, and ends before the first line
    that isn't indented. Both are running aggregates over the lines above.
    """
    x = T.trim(F.col("text"))
    rows = lines.select("doc", "line_no", x.alias("x"), (F.col("text").startswith("  ") | F.col("text").startswith("\t")).alias("indented"))
    x = F.col("x")
    after = {c: _number(x, rf"(?i)([0-9]+)\s*{c}") for c in COUNTED}
    rows = rows.withColumns({f"_{c}": v for c, v in after.items()})
    listed = x.rlike("(?i)tests?:")
    says = F.col("_passed").isNotNull() & F.when(listed, F.col("_total").isNotNull()).otherwise(F.col("_failed").isNotNull())
    total = F.coalesce("_total", sum((F.coalesce(f"_{c}", F.lit(0)) for c in COUNTED[2:]), F.col("_passed")))
    stated = {c: F.when(says, total if c == "total" else F.col(f"_{c}")) for c in COUNTED}
    for c, word in NAMED_BEFORE.items():
        stated[c] = F.coalesce(stated[c], F.when(~says, _number(x, rf"(?i)(?<![A-Za-z]){word}\s+([0-9]+)")))
    kind = F.when(says, "count")
    for name, pattern in KINDS:
        kind = kind.when(x.rlike(pattern), name)
    kind = kind.when((x == "") | F.col("indented"), "inner").otherwise("outer")
    rows = rows.withColumns({**stated, "kind": kind}).drop(*(f"_{c}" for c in COUNTED))
    own = Window.partitionBy("doc").orderBy("line_no")
    state = F.when(F.col("kind").isin("mark", "more"), 1).when(F.col("kind") == "outer", 0)
    open_ = F.coalesce(F.last(state, True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    rows = rows.withColumn("open", open_)
    starts = (F.col("kind") == "mark") | ((F.col("kind") == "more") & ~F.col("open"))
    inside = F.col("kind").isin("mark", "more") | ((F.col("kind") == "inner") & F.col("open") & (x != ""))
    rows = rows.withColumns({"_block": F.sum(starts.cast("int")).over(own), "inside": inside})
    return rows.withColumn("block", F.when(F.col("inside"), F.col("_block"))).drop("_block")


def test_counts(rows: DataFrame) -> DataFrame:
    """(doc, total, passed, failed, skipped): the last that was stated of each, and packages that ended after it."""
    doc = Window.partitionBy("doc")
    last = {f"_{c}": F.max(F.when(F.col(c).isNotNull(), F.col("line_no"))).over(doc) for c in COUNTED}
    rows = rows.withColumns(last)
    ended = {"total": F.lit(True), "passed": F.col("x").startswith("ok"), "failed": F.col("x").startswith("FAIL"), "skipped": F.lit(False)}

    def one(c: str) -> Column:
        later = (F.col("kind") == "package") & ended[c] & (F.col("line_no") > F.coalesce(F.col(f"_{c}"), F.lit(-1)))
        return (F.coalesce(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("line_no"))), F.lit(0)) + F.sum(later.cast("int"))).cast("long").alias(c)

    return rows.groupBy("doc").agg(*map(one, COUNTED))


def test_failures(rows: DataFrame, context: int = 10) -> DataFrame:
    """(doc, line_no, failure): each with the first ``context`` of its lines and all that name a failure."""
    w = Window.partitionBy("doc", "block").orderBy("line_no")
    kept = rows.where("inside").withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= context) | (F.col("kind") == "more"))
    blocks = kept.groupBy("doc", "block").agg(F.min("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("line_no", "x"))).alias("own"))
    blocks = blocks.select("doc", "line_no", F.array_join(F.transform("own", lambda r: r["x"]), "\n").alias("failure"))
    single = rows.where((F.col("kind") == "solo") | ((F.col("kind") == "package") & F.col("x").startswith("FAIL")))
    text = F.when(F.col("kind") == "solo", F.col("x")).otherwise(F.regexp_replace("x", r"^FAIL\s+(\S+).*", "FAIL $1"))
    return blocks.unionByName(single.select("doc", "line_no", text.alias("failure")))


def tests(lines: DataFrame, failures: int = 5, errors: int = 3, last: int = 5) -> DataFrame:
    """Totals, the first failures with their context, the first errors; the last lines where none of these is found."""
    rows = materialize(test_lines(lines))
    part = lambda c: F.when(F.col(c) > 0, F.format_string(f"%d {c}", c))
    counts = test_counts(rows).where("total > 0")
    head = _line(counts, 0, F.concat(F.format_string("%d tests: ", "total"), F.concat_ws(", ", *map(part, COUNTED[2:3] + COUNTED[1:2] + COUNTED[3:]))))
    failed = _first(test_failures(rows), failures, F.col("line_no"))
    out = head.unionByName(_line(failed.where("rank = 1"), 1, F.lit("FAILURES:"))).unionByName(_line(failed, 2, F.col("failure"), F.col("rank")))
    out = out.unionByName(_more(failed, failures, "failures", 3))
    wrong = rows.where(((F.col("kind") == "outer") | ((F.col("kind") == "inner") & ~F.col("open"))) & F.col("x").rlike(ERROR))
    wrong = _first(wrong, errors, F.col("line_no"))
    out = out.unionByName(_line(wrong.where("rank = 1"), 4, F.lit("ERRORS:"))).unionByName(_line(wrong, 5, F.col("x"), F.col("rank")))
    return _otherwise(lines, _joined(out), last, True, NOTHING)


# --- Diagnostics -------------------------------------------------------------

#: Where a diagnostic stands: before it, in parentheses or between colons; or without a file, below the file's own line.
PLACE = r"^(?:([^\s(][^(]*?)\([0-9]+,[0-9]+\):|(.+?):[0-9]+:[0-9]+:)\s*"
BARE_PLACE = r"^[0-9]+:[0-9]+\s+"
SEVERITY = r"^(?i:(error|warning))(?:\[([^\]]+)\])?(?![\w\[])"
LEADING, TRAILING = r"^([A-Z]+[0-9]+):?\s+", r"\s+([@A-Za-z][\w/@.-]*)\z"


def diagnostics(lines: DataFrame) -> DataFrame:
    """(doc, line_no, file, severity, rule) of the lines that are diagnostics of a compiler or linter.

    A line is taken apart from the left: its place, its severity, a code before or behind the message. With a place it needs a code,
    without one a severity and a colon. A line that is a path alone is the file of bare places below it.
    """
    bare = T.trim(F.col("text"))
    header = bare.rlike(r"^[^ ]*[\\/][^ ]*\.\w+\z")
    rows = lines.where(F.col("text").rlike(r"\S")).select("doc", "line_no", bare.alias("bare"), header.alias("header"))
    above = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("path", F.last(F.when(F.col("header"), F.col("bare")), True).over(above)).where("not header")
    got = lambda c, p, n=1: F.nullif(F.regexp_extract(c, p, n), F.lit(""))
    col = F.col
    rows = rows.withColumn("below", col("bare").rlike(BARE_PLACE))
    rows = rows.withColumn("file", F.when(col("below"), col("path")).otherwise(F.coalesce(got("bare", PLACE, 1), got("bare", PLACE, 2))))
    rows = rows.withColumns({"placed": col("below") | col("bare").rlike(PLACE), "rest": F.regexp_replace(F.regexp_replace("bare", PLACE, ""), BARE_PLACE, "")})
    rows = rows.withColumns({"severity": F.lower(got("rest", SEVERITY)), "code": got("rest", SEVERITY, 2), "said": F.regexp_replace("rest", SEVERITY, "")})
    colon = col("said").rlike(r"^:\s*\S")
    rows = rows.withColumns({"colon": colon, "said": F.regexp_replace("said", r"^:?\s*", "")})
    rows = rows.withColumn("lead", got("said", LEADING)).withColumn("tail", F.when(col("lead").isNull() & col("severity").isNotNull(), got("said", TRAILING)))
    code = F.when(col("placed"), F.coalesce("code", "lead", "tail")).otherwise(col("code"))
    message = F.when(col("placed") & col("code").isNull(), F.regexp_replace(F.when(col("lead").isNull() & col("severity").isNotNull(), F.regexp_replace("said", TRAILING, "")).otherwise(col("said")), LEADING, ""))
    shouted = col("rest").rlike("^(?:ERROR|WARNING|Error|Warning)")  # whatever it is about, it may be long
    message = F.coalesce(message, F.when(shouted & col("code").isNull(), F.left("said", F.lit(80))).otherwise(col("said")))
    rows = rows.withColumns({"found": F.when(col("placed"), code.isNotNull()).otherwise(col("severity").isNotNull() & col("colon")), "rule": F.concat_ws(": ", code, message)})
    return rows.where("found").select("doc", "line_no", "file", F.coalesce("severity", F.lit("error")).alias("severity"), "rule")


def lint_rules(lines: DataFrame) -> DataFrame:
    """Diagnostics by rule: number, files, errors, warnings and first line."""
    of = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(f"{s}s")
    return diagnostics(lines).groupBy("doc", "rule").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), of("error"), of("warning"), F.min("line_no").alias("line_no"))


def lint(lines: DataFrame, rules: int = 10, first: int = 15) -> DataFrame:
    """Totals and the commonest rules; the first lines where there is no diagnostic."""
    found = materialize(lint_rules(lines))
    sums = found.groupBy("doc").agg(F.sum("errors").alias("e"), F.sum("warnings").alias("w"), F.count("*").alias("k"))
    out = _line(sums, 0, F.format_string("%d errors, %d warnings (%d unique rules)", "e", "w", "k")).unionByName(_line(sums, 1, F.lit("")))
    best = _first(found, rules, F.col("n").desc(), F.col("line_no"))
    where = F.when(F.col("files") > 0, F.format_string(" in %d file%s", "files", F.when(F.col("files") > 1, "s").otherwise(""))).otherwise("")
    out = out.unionByName(_line(best, 2, F.format_string("  %s (×%d%s)", "rule", "n", where), F.col("rank"))).unionByName(_more(best, rules, "rules", 3, "  "))
    return _otherwise(lines, _joined(out), first, False, "no errors", "lines")


# --- Logs and builds ---------------------------------------------------------


def log_groups(lines: DataFrame) -> DataFrame:
    """Lines grouped by what is left without times, ids and addresses, over all of a document."""
    rows = lines.where(F.col("text").rlike(r"\S")).withColumns({"key": T.log_key(F.col("text")), "text": T.trim(F.col("text"))})
    return rows.groupBy("doc", "key").agg(F.count("*").alias("n"), F.min_by("text", "line_no").alias("first_line"), F.min("line_no").alias("line_no"))


def logs(lines: DataFrame, shown: int = 30) -> DataFrame:
    """Lines without their repeats, in the order of their first occurrence."""
    groups = materialize(log_groups(lines))
    sums = groups.groupBy("doc").agg(F.sum("n").alias("n"), F.count("*").alias("k")).where("n > k")
    out = _line(sums, 0, F.format_string("%d lines → %d unique (%d duplicates collapsed)", "n", "k", F.col("n") - F.col("k")))
    some = _first(groups, shown, F.col("line_no"))
    text = F.when(F.col("n") > 1, F.format_string("%s (×%d)", "first_line", "n")).otherwise(F.col("first_line"))
    out = out.unionByName(_line(some, 1, text, F.col("rank"))).unionByName(_more(some, shown, "unique lines", 2))
    return _otherwise(lines, _joined(out), 1, True, NOTHING)


# Words that make a build line an error or a warning, and marks that begin one.
_FIRST_OR_AFTER_SPACE, _ENDS = r"(?:^|\s)", r"(?![A-Za-z0-9_])"
ERRORS = (rf"{_FIRST_OR_AFTER_SPACE}(?:error|ERROR|FAILED){_ENDS}", r"(?i)(?<![A-Za-z0-9_])error\s*:", "^[✖×✗]")
WARNINGS = (rf"(?i){_FIRST_OR_AFTER_SPACE}warn(?:ing)?{_ENDS}", r"(?i)(?<![A-Za-z0-9_])warning\s*:")


def build_lines(lines: DataFrame) -> DataFrame:
    """Distinct error and warning lines in the order of their first occurrence."""
    bare = T.trim(F.col("text"))
    any_of = lambda ps: F.greatest(*[bare.rlike(p) for p in ps])
    kind = F.when(any_of(ERRORS), "error").when(any_of(WARNINGS), "warning")
    rows = lines.withColumns({"kind": kind, "text": bare}).where("kind is not null and text <> ''")
    return rows.groupBy("doc", "kind", "text").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))


def builds(lines: DataFrame, errors: int = 12, warnings: int = 6, last: int = 4) -> DataFrame:
    """Numbers of error and warning lines and the first of them, each once; the last lines where there are none."""
    found, out = materialize(build_lines(lines)), None
    for part, (kind, cap) in enumerate((("error", errors), ("warning", warnings))):
        own = found.where(F.col("kind") == kind)
        sums = own.groupBy("doc").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
        once = F.when(F.col("k") < F.col("n"), F.format_string(" (%d unique)", "k")).otherwise("")
        some = _first(own, cap, F.col("line_no"))
        rows = _line(sums, 3 * part, F.format_string(f"%d {kind} line(s)%s:", "n", once)).unionByName(_line(some, 3 * part + 1, F.col("text"), F.col("rank")))
        rows = rows.unionByName(_more(some, cap, f"unique {kind}s", 3 * part + 2))
        out = rows if out is None else out.unionByName(rows)
    return _otherwise(lines, _joined(out), last, True, NOTHING)


#: Reports by the category of a command.
REPORTS = {"test": tests, "lint": lint, "log": logs, "build": builds}
