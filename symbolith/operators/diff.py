"""Unified diffs as relations: files, hunks and added lines, and an interval join of hunks with what stands in lines.

A diff (diff) may be of several files. Its lines are numbered once; a line's file and hunk are the last headers above it, and the
number of a line in the new file is its hunk's start plus the kept and added lines before it. A line that
looks like a header inside a hunk is told by the hunk's length, which its header gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolith.functions import text as T

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
#: Lines of a block, by which intervals meet lines.
BLOCK = 64


def _size(text: Column, group: int) -> Column:
    """Number of lines that a hunk header gives; one if it gives none."""
    got = F.regexp_extract(text, HUNK, group)
    return F.when(got == "", 1).otherwise(got.cast("int"))


def added(diffs: DataFrame, text_col: str = "diff") -> DataFrame:
    """(path, line, text) of all added lines, by their number in the new file."""
    rows = diffs.withColumn("_diff", F.monotonically_increasing_id()).select("_diff", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("_at", "text"))
    above = Window.partitionBy("_diff").orderBy("_at")
    text = F.col("text")
    head = text.rlike(HUNK)
    rows = rows.withColumns(
        {
            "_hunk": F.last(F.when(head, F.col("_at")), True).over(above),
            "_start": F.last(F.when(head, F.regexp_extract(text, HUNK, 3).cast("int")), True).over(above),
            "_old": F.last(F.when(head, _size(text, 2)), True).over(above),
            "_new": F.last(F.when(head, _size(text, 4)), True).over(above),
            "_kind": F.when(head, "@").when(text.startswith("+"), "+").when(text.startswith("-"), "-").when(text.startswith("\\"), "").otherwise(" "),
        }
    )
    earlier = Window.partitionBy("_diff", "_hunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda *kinds: F.coalesce(F.sum(F.col("_kind").isin(*kinds).cast("int")).over(earlier), F.lit(0))
    rows = rows.withColumns({"_news": count("+", " "), "_olds": count("-", " ")})
    more = ~head & F.col("_hunk").isNotNull() & ((F.col("_news") < F.col("_new")) | (F.col("_olds") < F.col("_old")))
    rows = rows.withColumn("_inside", more)
    name = T.trim(F.regexp_replace(F.substring_index(F.substring(text, 5, 2**31 - 1), "\t", 1), "^b/", ""))
    rows = rows.withColumn("path", F.last(F.when(text.startswith("+++ ") & ~F.col("_inside"), name), True).over(above))
    rows = rows.where(F.col("_inside") & (F.col("_kind") == "+") & F.col("path").isNotNull() & (F.col("path") != "/dev/null"))
    return rows.select("path", (F.col("_start") + F.col("_news")).cast("int").alias("line"), F.substring(text, 2, 2**31 - 1).alias("text"))


def intervals(lines: DataFrame) -> DataFrame:
    """(path, first, last) of the runs of neighbouring lines (path, line)."""
    w = Window.partitionBy("path").orderBy("line")
    rows = lines.select("path", "line").distinct().withColumn("run", F.col("line") - F.row_number().over(w))
    return rows.groupBy("path", "run").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("run")


def within(rows: DataFrame, spans: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """The rows whose line lies in an interval (path, first, last) of their file.

    Intervals meet lines by file and block of BLOCK lines, so a long file with many hunks makes no pairs of all with all. Intervals of
    a file don't overlap, as ``intervals`` gives them.
    """
    spans = spans.select(F.col("path").alias("_path"), "first", "last", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))).alias("_block"))
    meet = (F.col(path) == F.col("_path")) & (F.floor(F.col(line) / BLOCK) == F.col("_block")) & F.col(line).between(F.col("first"), F.col("last"))
    return rows.join(spans, meet, "left_semi")


def added_content(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, content) of the files' lines that ``lines`` (path, line) adds, one below the other."""
    own = files.select("path", F.posexplode(T.lines(F.col("content"))).alias("_at", "text")).select("path", (F.col("_at") + 1).alias("line"), "text")
    kept = within(own, intervals(lines))
    rows = kept.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("x"))
    return rows.select("path", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("content"))
