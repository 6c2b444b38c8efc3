"""Source trees as file relations, with skip rules, limits and an incremental cache.

A listing is (path, size, mtime, ord, content): ``content`` is read only where it is selected.
Directories are pruned by predicates on path segments; size and name tests stand before any
use of the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.operators.extract import definitions, language

# Directories that are never scanned, and those that are skipped unless included.
ALWAYS_SKIP = (
    "node_modules", ".git", "dist", "build", "coverage", ".next", "__pycache__", ".tox", ".venv", "venv", "vendor", "target", ".cache", ".turbo",
)
DEFAULT_SKIP = (".github", "archive", "backups", "backup", "logs", "tmp", "uploads", "media", "data", "content", "public", "static", "assets")
MAX_SIZE, MAX_HTML_SIZE = 500 * 1024, 5 * 1024 * 1024
MAX_DEPTH, MAX_FILES = 8, 2000
CACHE_VERSION = 1


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``, with paths relative to it."""
    base = root.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    own = F.regexp_replace(F.col("path"), r"^[a-zA-Z]+:/*", "/")
    start = F.instr(own, base)
    return rows.select(
        F.substring(own, start + len(base), F.length(own)).alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        F.decode("content", "UTF-8").alias("content"),
    )


def gitignore_dirs(lines: DataFrame) -> DataFrame:
    """(dir) of plain directory entries, the last of an entry and its negation counts; lines: (line_no, text)."""
    bare = T.trim(F.col("text"))
    rows = lines.withColumns({"neg": bare.startswith("!"), "dir": F.regexp_extract(bare, r"^!?([A-Za-z0-9_-]+)/?\z", 1)}).where("dir <> ''")
    return rows.groupBy("dir").agg(F.max_by("neg", "line_no").alias("neg")).where("not neg").select("dir")


def scan_config(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """skipDirs and includeDirs of a JSON file; empty lists if it is missing or malformed."""
    try:
        row = spark.read.option("multiLine", "true").schema("skipDirs array<string>, includeDirs array<string>").json(path).first()
    except Exception:  # no such file
        row = None
    return {k: list((row[k] if row else None) or []) for k in ("skipDirs", "includeDirs")}


def skipped(dirs: Column, skip: Column, always: Column) -> Column:
    """Whether a directory on the way is pruned."""

    def bad(d: Column) -> Column:
        odd = d.startswith(".") | d.contains(" ") | d.rlike("(?i)backup")
        return F.array_contains(always, d) | F.array_contains(skip, d) | odd

    return F.exists(dirs, bad)


def scan(
    files: DataFrame,
    max_depth: int = MAX_DEPTH,
    max_files: int = MAX_FILES,
    skip_dirs: tuple[str, ...] = (),
    include_dirs: tuple[str, ...] = (),
) -> DataFrame:
    """Code files in walk order, with lang, lines, modified and the two truncation flags.

    The limit counts files in the order of a walk that goes through names in order; flags tell
    whether a deeper directory or a further file was left out.
    """
    parts = F.split("path", "/")
    dirs, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    skip = [d for d in (*DEFAULT_SKIP, *skip_dirs) if d not in include_dirs]
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    included = F.filter(dirs, lambda d: ~F.array_contains(strings(include_dirs), d) | F.array_contains(strings(ALWAYS_SKIP), d))
    lang = language(F.col("path"))
    limit = F.when(lang == "html", MAX_HTML_SIZE).otherwise(MAX_SIZE)
    rows = files.withColumns({"lang": lang, "depth": F.size(parts) - 1})
    rows = rows.where(F.col("lang").isNotNull() & ~name.startswith(".") & (F.col("size") <= limit) & ~skipped(included, strings(skip), strings(ALWAYS_SKIP)))
    deep = rows.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("_deepest"))
    rows = rows.where(F.col("depth") <= max_depth)
    first = rows.select("path").orderBy("path").limit(max_files + 1)
    w = Window.orderBy("path")  # at most max_files + 1 narrow rows
    order = first.withColumns({"ord": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy())}).where(F.col("ord") <= max_files)
    out = rows.join(F.broadcast(order), "path") if max_files <= 100_000 else rows.join(order, "path")
    out = out.crossJoin(F.broadcast(deep))  # one row
    return out.select(
        "path", "lang", F.size(T.lines(F.col("content"))).alias("lines"), "size", "mtime", F.to_date("mtime").alias("modified"), "content", "ord",
        (F.col("_n") > max_files).alias("truncated"), (F.col("_deepest") > max_depth).alias("depth_truncated"),
    )


def cache_of(files: DataFrame, defs: DataFrame) -> DataFrame:
    """What a scan leaves for the next: (path, size, mtime, lang, lines, symbols, version)."""
    symbols = defs.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("category", "name", "line", "pass")).alias("symbols"))
    rows = files.select("path", "size", "mtime", "lang", "lines").join(symbols, "path", "left")
    empty = F.array().cast(symbols.schema["symbols"].dataType)
    return rows.withColumns({"symbols": F.coalesce("symbols", empty), "version": F.lit(CACHE_VERSION)})


def incremental(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to be parsed again, and cached rows that still hold.

    A row holds if path, size and time are equal, its version is current and its symbols are
    there. Files that are gone appear in neither.
    """
    good = cache.where((F.col("version") == CACHE_VERSION) & F.col("symbols").isNotNull())
    on = ["path", "size", "mtime"]
    return files.join(good.select(*on), on, "left_anti"), good.join(files.select(*on), on, "left_semi")


def compare(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, change) of files added, modified (also: cached by another version) or deleted since the cache was made."""
    good = cache.select("path", F.struct("size", "mtime").alias("a"), ((F.col("version") == CACHE_VERSION) & F.col("symbols").isNotNull()).alias("good"))
    rows = listing.select("path", F.struct("size", "mtime").alias("b")).join(good, "path", "full")
    kind = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").when(~F.col("good") | (F.col("a") != F.col("b")), "modified")
    return rows.select("path", kind.alias("change")).where("change is not null")


def rescan(files: DataFrame, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(definitions, new cache), parsing only what changed."""
    if cache is None:
        defs = definitions(files)
        return defs, cache_of(files, defs)
    changed, held = incremental(files, cache)
    old = held.select("path", F.explode("symbols").alias("s")).select("s.category", "s.name", F.col("path").alias("file"), "s.line", "s.pass")
    new = definitions(changed)
    return new.unionByName(old), cache_of(changed, new).unionByName(held.select(*cache.columns))
