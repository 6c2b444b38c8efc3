"""Overviews of a registry and its files, as relations that a printer only has to join with newlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.session import materialize

MAX_CLASSES, MAX_EXPORTS = 50, 80


def tree(files: DataFrame, max_files: int = 100) -> DataFrame:
    """Directories in order until ``max_files`` files are shown; the last may be partial.

    Files are counted per directory first, so the running sum sees directories, not files.
    """
    dirs = files.withColumn("dir", T.dirname(F.col("path"))).groupBy("dir").agg(F.count("*").alias("files"))
    first = dirs.orderBy("dir").limit(max_files)  # each has a file, so no more are shown
    w = Window.orderBy("dir").rowsBetween(Window.unboundedPreceding, -1)
    rows = first.withColumn("before", F.coalesce(F.sum("files").over(w), F.lit(0))).where(F.col("before") < max_files)
    shown = F.least(F.col("files"), max_files - F.col("before"))
    return rows.select("dir", "files", shown.alias("shown"), (shown < F.col("files")).alias("partial"))


def symbol_lists(reg: DataFrame) -> DataFrame:
    """Names of classes and of exports, each only if there are few enough, sorted."""
    caps = {"classes": MAX_CLASSES, "exports": MAX_EXPORTS}
    parts = []
    for category, cap in caps.items():
        few = reg.where(F.col("category") == category).select("category", "name", "file").orderBy("name").limit(cap + 1)
        n = Window.partitionBy("category")
        parts.append(few.withColumn("n", F.count("*").over(n)).where(F.col("n") <= cap).drop("n"))
    return parts[0].unionByName(parts[1])


def _grams(x: F.Column, size: F.Column) -> F.Column:
    """Distinct runs of ``size`` characters."""
    last = F.char_length(x) - size + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(x, i, size))))


def containing(parts: DataFrame, wholes: DataFrame, part: str, whole: str, size: int = 3) -> DataFrame:
    """Pairs of rows of which the one's text contains the other's, by an index of runs of ``size`` characters.

    A text meets those that hold the rarest of its runs; a text shorter than that is a run itself. An empty text is in none.
    """
    sizes = F.array(*map(F.lit, range(1, size + 1)))
    index = wholes.withColumn("_size", F.explode(sizes)).withColumn("_gram", F.explode(_grams(F.col(whole), F.col("_size")))).drop("_size")
    index = materialize(index)
    held = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    asked = parts.select(part).distinct().where(F.char_length(part) > 0)
    asked = asked.withColumn("_gram", F.explode(_grams(F.col(part), F.least(F.char_length(part), F.lit(size)))))
    rarest = asked.join(held, "_gram", "left").groupBy(part).agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return parts.join(rarest, part).join(index, "_gram").where(F.contains(F.col(whole), F.col(part))).drop("_gram")


def routes_by_file(routes: DataFrame) -> DataFrame:
    """Files with the number and the distinct methods of their routes, and the mount that fits the name."""
    own = routes.where("method <> 'MOUNT'").groupBy("file").agg(F.count("*").alias("routes"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))
    stem = F.lower(F.regexp_replace(F.regexp_replace(T.basename(F.col("file")), r"\.[^.]*\z", ""), "[-_]", ""))
    mounts = routes.where("method = 'MOUNT'").select(F.col("path").alias("mount"), F.lower(F.regexp_replace("path", "[/-]", "")).alias("_m"), F.col("line").alias("_l"))
    fit = containing(own.select("file", stem.alias("_s")), mounts, "_s", "_m").groupBy("file").agg(F.min_by("mount", F.struct("_l", "mount")).alias("mount"))
    return own.join(fit, "file", "left")


def page_list(pages: DataFrame) -> DataFrame:
    return pages.select("page", "title", F.size("scripts").alias("scripts")).orderBy("page")


def managed_block(watchlist: DataFrame, counts: DataFrame, exports: DataFrame, routes: DataFrame) -> str:
    """The block of rules and facts kept in an agent's notes: bounded lists only."""
    seen = [f"- {r['symbol']} ({r['count']})" for r in watchlist.orderBy(F.desc("count"), "symbol").limit(15).collect()]
    facts = [f"- {r['category']}: {r['symbols']}" for r in counts.orderBy("category").collect()]
    names = [r["name"] for r in exports.select("name").distinct().orderBy("name").limit(40).collect()]
    paths = [r["route"] for r in routes.select("route").distinct().orderBy("route").limit(30).collect()]
    parts = ["Check that a symbol exists before using it; look it up in the registry.", "", "Reported before:", *(seen or ["- none"]), "", "Symbols:", *facts]
    parts += ["", "Exports: " + ", ".join(names)] if names else []
    parts += ["", "Routes: " + ", ".join(paths)] if paths else []
    return "\n".join(parts)


def prompt(meta: dict | None, watchlist: DataFrame, minimal: bool = False) -> str:
    """A short reminder with the state of the registry and the names reported most."""
    head = "Verify names against the registry before using them."
    if minimal:
        return head
    state = f"Registry: {meta['symbols']} symbols in {meta['files']} files." if meta else "No registry yet: index the project first."
    seen = ", ".join(f"{r['symbol']} ({r['count']})" for r in watchlist.orderBy(F.desc("count"), "symbol").limit(10).collect())
    return "\n".join([head, state, *([f"Often wrong: {seen}"] if seen else [])])
