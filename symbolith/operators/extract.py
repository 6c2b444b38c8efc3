"""Source lines to symbol definitions.

Languages with line rules are one cascade of built-in expressions per language: no Python. Only
JavaScript, TypeScript and scripts inside pages need a parser and go through an Arrow-batched
``mapInPandas``; a text that it can't parse comes back to the line rules.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolith.functions import text as T

from . import js
from .rules import BULK_EXPORT, JS_FALLBACK, LANGUAGES, MEMBER_EXPORT, MOUNT, NESTED, ROUTE, RULES, SKELETON, Rule

DEFS = "category string, name string, file string, line int, pass int"


def language(path: Column) -> Column:
    """Language of a path by its extension; NULL for files that aren't scanned."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, T.extension(path))


def source_lines(files: DataFrame) -> DataFrame:
    """(file, lang, line, text) of files (path, lang, content)."""
    return files.select(F.col("path").alias("file"), "lang", F.posexplode(T.lines(F.col("content"))).alias("_at", "text")).select(
        "file", "lang", (F.col("_at") + 1).alias("line"), F.regexp_replace("text", r"\r\z", "").alias("text")
    )


#: What holds braces that open nothing: strings, characters and the rest of a line behind a comment.
QUOTED = r'"(?:[^"\\]|\\.)*+"|`[^`]*+`|' + r"'(?:[^'\\]|\\[^']++)'|//.*+"


def depths(lines: DataFrame) -> DataFrame:
    """``lines`` with ``depth``, the braces of their file that are open where a line begins, never below 0.

    A running sum over a file's lines. Its least value so far says how many braces were closed that nothing had opened:
    these don't make what follows outer. A string or comment that goes on to the next line is taken as code there.
    """
    code = F.regexp_replace("text", QUOTED, "")
    count = lambda c: F.char_length(code) - F.char_length(F.replace(code, F.lit(c), F.lit("")))
    own = Window.partitionBy("file").orderBy("line")
    above = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("_sum", F.sum(count("{") - count("}")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_open": F.coalesce(F.last("_sum").over(above), F.lit(0)), "_low": F.least(F.coalesce(F.min("_sum").over(above), F.lit(0)), F.lit(0))})
    return rows.withColumn("depth", (F.col("_open") - F.col("_low")).cast("int")).drop("_sum", "_open", "_low")


def top_level(lines: DataFrame, langs: tuple[str, ...] = tuple(NESTED)) -> DataFrame:
    """Lines of ``langs`` outside all braces, and all lines of other languages."""
    outer = depths(lines.where(F.col("lang").isin(*langs))).where("depth = 0").drop("depth")
    return outer.unionByName(lines.where(~F.col("lang").isin(*langs)))


def by_rules(lines: DataFrame, nested: bool = True, fallback: bool = False) -> DataFrame:
    """Definitions by line rules; without ``nested`` only those of Go and Rust that stand outside all braces.

    The first rule that matches a line gives its symbol. The cascade is long, so it runs inside a
    higher-order function, which Spark evaluates without generating code for every branch.
    """
    rules = RULES | NESTED | ({"javascript": JS_FALLBACK, "typescript": JS_FALLBACK} if fallback else {})

    def cascade(x: Column) -> Column:
        lang, text, out = x["lang"], x["text"], None
        for name, own in rules.items():
            for r in own:
                got = F.regexp_extract(text, r.pattern, 1)
                hit = (lang == name) & text.rlike(r.pattern)
                hit = hit & ~got.isin(*r.refuse) if r.refuse else hit
                value = F.struct(F.lit(r.category).alias("category"), got.alias("name"))
                out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    lines = lines if nested else top_level(lines)
    comment = (F.col("lang") == "bash") & F.col("text").rlike(r"^\s*#")
    found = F.transform(F.array(F.struct("lang", "text")), cascade)
    rows = lines.where(F.col("lang").isin(*rules) & ~comment).select("file", "line", F.inline(F.filter(found, lambda f: f.isNotNull())))
    return rows.select("category", "name", "file", "line", F.lit(0).alias("pass"))


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"]):
            found, ok = js.symbols(content or "")
            if not ok:
                found = [(r.category, m[1], k + 1, 0) for k, x in enumerate((content or "").split("\n")) for r, m in _first(x)]
            rows += [(c, n, path, line, p) for c, n, line, p in found]
        yield pd.DataFrame(rows, columns=["category", "name", "file", "line", "pass"])


def _first(line: str) -> list[tuple[Rule, re.Match]]:
    for r in JS_FALLBACK:
        if m := re.search(r.pattern, line):
            return [(r, m)]
    return []


def javascript(files: DataFrame) -> DataFrame:
    rows = files.where(F.col("lang").isin("javascript", "typescript")).select("path", "content").mapInPandas(_parsed, DEFS)
    return rows.unionByName(module_exports(source_lines(files.where(F.col("lang").isin("javascript", "typescript")))))


def module_exports(lines: DataFrame) -> DataFrame:
    """Exports by assignment to the module object."""
    one = F.regexp_extract("text", MEMBER_EXPORT, 1)
    many = F.transform(F.split(F.regexp_extract("text", BULK_EXPORT, 1), ","), lambda s: F.split(T.trim(s), r"[:\s]")[0])
    names = F.when(F.col("text").rlike(MEMBER_EXPORT), F.array(one)).when(F.col("text").rlike(BULK_EXPORT), F.filter(many, lambda n: n.rlike(r"^\w+\z")))
    rows = lines.where(names.isNotNull()).select("file", "line", F.posexplode(names).alias("k", "name"))
    return rows.select(F.lit("exports").alias("category"), "name", "file", "line", (F.col("k") + 1_000_000).alias("pass"))


def python_parsed(files: DataFrame) -> DataFrame:
    """Functions and classes of Python by its own parser; texts that it refuses go by line rules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError):
                    continue
                for k, n in enumerate(ast.walk(tree)):
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        rows.append(("classes" if isinstance(n, ast.ClassDef) else "functions", n.name, path, n.lineno, k))
            yield pd.DataFrame(rows, columns=["category", "name", "file", "line", "pass"])

    return files.where("lang = 'python'").select("path", "content").mapInPandas(run, DEFS)


def definitions(files: DataFrame, nested: bool = True, parsers: tuple[str, ...] = ()) -> DataFrame:
    """All definitions of files (path, lang, content). JSON and Markdown give none.

    ``parsers`` names languages that are parsed where the task has a parser for them: ``python``. Texts that it
    refuses, and constants, go by line rules.
    """
    lines = source_lines(files)
    if "python" in parsers:
        parsed = python_parsed(files)
        refused = files.where("lang = 'python'").select(F.col("path").alias("file")).join(parsed.select("file").distinct(), "file", "left_anti")
        own = by_rules(lines.where("lang = 'python'"))
        own = own.where("category = 'variables'").unionByName(own.where("category <> 'variables'").join(refused, "file", "left_semi"))
        ruled = by_rules(lines.where("lang <> 'python'"), nested).unionByName(own).unionByName(parsed)
    else:
        ruled = by_rules(lines, nested)
    return ruled.unionByName(javascript(files)).unionByName(page_scripts(files.where("lang = 'html'")))


def routes(lines: DataFrame) -> DataFrame:
    """(route, method, path, file, line): handlers, and mounts below /api; one per line."""
    method = F.when(F.col("text").rlike(ROUTE), F.upper(F.regexp_extract("text", ROUTE, 1))).when(F.col("text").rlike(MOUNT), "MOUNT")
    path = F.when(F.col("text").rlike(ROUTE), F.regexp_extract("text", ROUTE, 2)).otherwise(F.regexp_extract("text", MOUNT, 1))
    rows = lines.withColumns({"method": method, "path": path}).where("method is not null")
    return rows.select(F.concat_ws(" ", "method", "path").alias("route"), "method", "path", "file", "line")


def pages(html: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(page, file, title, scripts) of HTML texts; the title falls back to the name."""
    c = F.col(content)
    title = T.trim(F.regexp_extract(c, r"(?is)<title[^>]*>([^<]+)</title>", 1))
    src = F.regexp_extract_all(c, F.lit(r"(?is)<script[^>]+src\s*=\s*[\"']([^\"']+)[\"'][^>]*>"), F.lit(1))
    local = F.filter(src, lambda s: ~s.startswith("http") & ~s.startswith("//"))
    name = T.basename(F.col(path))
    return html.select(name.alias("page"), F.col(path).alias("file"), F.when(title == "", name).otherwise(title).alias("title"), local.alias("scripts"))


INLINE = r"(?is)<script(?![^>]*(?<![A-Za-z0-9_])src(?![A-Za-z0-9_]))[^>]*>(.*?)</script>"


def page_scripts(html: DataFrame) -> DataFrame:
    """Definitions in inline scripts, at their lines in the page."""
    inline = re.compile(INLINE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                for m in inline.finditer(content or ""):
                    above = content.count("\n", 0, m.start())
                    found, ok = js.symbols(m[1])
                    if not ok:
                        found = [(r.category, h[1], k + 1, 0) for k, x in enumerate(m[1].split("\n")) for r, h in _first(x)]
                    rows += [(c, n, path, line + above, p) for c, n, line, p in found]
            yield pd.DataFrame(rows, columns=["category", "name", "file", "line", "pass"])

    return html.select("path", "content").mapInPandas(run, DEFS)


SKELETONS = "file string, kind string, owner string, signature string, line int"


def skeletons(files: DataFrame) -> DataFrame:
    """Signatures of files: parsed for JavaScript, by line patterns for other languages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, *x) for x in js.skeleton(content or "")]
                except js.Unbalanced:
                    continue
            yield pd.DataFrame(rows, columns=["file", "kind", "owner", "signature", "line"])

    script = F.col("lang").isin("javascript", "typescript")
    parsed = files.where(script).select("path", "content").mapInPandas(run, SKELETONS)
    lines = source_lines(files.where(~script)).where(F.length("text") <= 300)
    hit = F.greatest(*[F.col("text").rlike(p) for p in SKELETON])
    other = lines.where(hit).select(
        "file", F.lit("declaration").alias("kind"), F.lit("").alias("owner"), F.regexp_replace(T.trim(F.col("text")), r"\s*\{\s*\z", "").alias("signature"), "line"
    )
    return parsed.unionByName(other)
