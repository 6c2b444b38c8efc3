"""Analytics over the event log and the condensing log.

Events: (symbol, file, type, ts, seq); ``seq`` is the order of appending and decides what is
newest and last. Condensing log: (seq, command, category, original_tokens, compressed_tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolith.functions import text as T

KEEP_EVENTS = 500
FREQUENT = 3
RECENT = 10
KEEP_COMMANDS = 100


def newest(events: DataFrame, limit: int = KEEP_EVENTS) -> DataFrame:
    """The newest ``limit`` events; each task keeps that many at most."""
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def frequent(events: DataFrame, least: int = FREQUENT) -> DataFrame:
    """Symbols seen ``least`` times or more: count, last type and time, distinct files."""
    file = F.when(F.coalesce(F.col("file"), F.lit("")) != "", F.col("file"))
    order = F.struct("ts", "seq")
    rows = events.groupBy("symbol").agg(
        F.count("*").alias("count"),
        F.max_by("type", order).alias("type"),
        F.max_by("ts", order).alias("last_seen"),
        F.count_distinct(file).alias("files"),
    )
    return rows.where(F.col("count") >= least)


def watchlist(events: DataFrame, least: int = FREQUENT) -> DataFrame:
    return events.groupBy("symbol").agg(F.count("*").alias("count")).where(F.col("count") >= least)


def recent(events: DataFrame, limit: int = RECENT) -> DataFrame:
    return newest(events, limit)


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("count"))


def report(events: DataFrame, top: int = 20, shown_files: int = 3) -> DataFrame:
    """The top frequent symbols with some of their files, ready to be printed."""
    best = frequent(events).orderBy(F.desc("count"), "symbol").limit(top)
    files = events.where("file <> ''").groupBy("symbol", "file").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("symbol").orderBy("seq")
    files = files.withColumn("n", F.row_number().over(w)).where(F.col("n") <= shown_files)
    files = files.groupBy("symbol").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "file"))), lambda x: x["file"]), ", ").alias("shown"))
    return best.join(files, "symbol", "left")


def condensing_log(rows: DataFrame) -> DataFrame:
    """Adds tokens saved, never negative, and the shortened command."""
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("compressed_tokens"))
    return rows.withColumns({"saved": saved, "command": T.short_command(F.col("command"))})


def _percent(saved: Column, original: Column) -> Column:
    return T.half_up(saved / F.greatest(F.lit(1), original) * 100).cast("long")


def condensing_stats(log: DataFrame) -> DataFrame:
    """Totals by category and over all (category NULL), weighted by tokens; one pass."""
    out = log.rollup("category").agg(
        F.count("*").alias("commands"), F.sum("saved").alias("tokens_saved"), F.sum("original_tokens").alias("original_tokens"), F.grouping("category").alias("is_total")
    )
    return out.withColumn("savings_pct", _percent(F.col("tokens_saved"), F.col("original_tokens")))


def top_commands(log: DataFrame, keep: int = KEEP_COMMANDS, top: int = 5) -> DataFrame:
    """Commands that saved most, among the newest ``keep`` only; ties go to the older."""
    return log.orderBy(F.desc("seq")).limit(keep).orderBy(F.desc("saved"), "seq").limit(top)


def debounced(events: DataFrame, key: str, gap: str, item: str) -> DataFrame:
    """Flushes of a trailing-edge debounce: each holds the distinct items since the last one."""
    s = F.session_window("ts", gap)
    return events.groupBy(key, s).agg(F.count("*").alias("events"), F.count_distinct(item).alias("items")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "items"
    )


def score(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall in percent per language and over all (lang NULL); both: (lang, name)."""
    a, b = found.select("lang", "name").distinct().withColumn("f", F.lit(1)), truth.select("lang", "name").distinct().withColumn("t", F.lit(1))
    both = a.join(b, ["lang", "name"], "full")
    hit = F.sum(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0))
    rows = both.rollup("lang").agg(hit.alias("hits"), F.count("f").alias("found"), F.count("t").alias("expected"), F.grouping("lang").alias("is_total"))
    pct = lambda n: F.when(F.col(n) == 0, 100).otherwise(F.floor(F.col("hits") * 100 / F.col(n) + 0.5)).cast("long")
    return rows.withColumns({"precision_pct": pct("found"), "recall_pct": pct("expected")})
