"""Change streams: listings compared, changes debounced, registries refreshed in micro-batches.

A file source never sees changes or deletions, so a watcher compares listings: ``sources.tree_stream`` does it
as a streaming source, ``changes`` between two relations. Changes stream as (project, path, ts). A trailing-edge debounce of
recorded changes is a session window over each project's; that of a running watcher has timers (``streaming.debounce``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symbolith.operators.extract import language
from symbolith.sources.files import ALWAYS_SKIP
from symbolith.streaming import debounce


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, modified or deleted code files between two listings (path, size, mtime)."""
    a = before.select("path", F.struct("size", "mtime").alias("a"))
    b = after.select("path", F.struct("size", "mtime").alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    rows = a.join(b, "path", "full").withColumn("change", kind).where("change is not null")
    return watched(rows).select("path", "change")


def watched(paths: DataFrame, max_depth: int = 12) -> DataFrame:
    """Rows whose path is a code file outside skipped directories."""
    parts = F.split("path", "/")
    bad = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*ALWAYS_SKIP) | p.startswith("."))
    return paths.where(language(F.col("path")).isNotNull() & ~bad & (F.size(parts) - 1 <= max_depth))


def flushes(stream: DataFrame, gap: str = "600 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Flushes of a stream of changes (project, path, ts): start, end, number and distinct paths.

    The session stays open while changes come within the gap. The watermark bounds its state.
    """
    w = F.session_window("ts", gap)
    out = watched(stream).withWatermark("ts", late).groupBy("project", w).agg(F.count("*").alias("changes"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.select("project", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "changes", "paths")


OUTCOME = "project string, flush long, attempt int, ok boolean, error string"


@dataclass
class Watcher:
    """Runs a refresh for each debounced flush of a stream of changes (project, path, ts).

    How a flush went is written to a table below ``home`` that the debounce reads as a second input: after a failure
    its timer emits the flush once more, a second later. ``refresh`` gets the flushes of a batch.
    """

    refresh: Callable[[DataFrame], None]
    home: str
    gap_ms: int = 600
    retry_ms: int = debounce.RETRY_MS
    scans: int = 0
    failures: int = 0
    recoveries: int = 0
    last_error: str = ""
    pending: bool = False
    query: StreamingQuery | None = field(default=None, repr=False)

    def batch(self, df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            if df.isEmpty():
                return
            again = not df.where("attempt > 0").isEmpty()
            ok = True
            try:
                self.refresh(df)
                self.scans += 1
                self.recoveries += again
                self.last_error = ""
            except Exception as e:  # kept for the health report; the stream goes on
                ok, self.last_error = False, str(e)
                self.failures += 1
            self.pending = not ok and not df.where("attempt = 0").isEmpty()
            rows = df.select("project", "flush", "attempt", F.lit(ok).alias("ok"), F.lit(self.last_error).alias("error"))
            rows.write.mode("append").parquet(f"{self.home}/outcomes")
        finally:
            df.unpersist()

    def start(self, changes: DataFrame, every: str = "200 milliseconds") -> StreamingQuery:
        spark = changes.sparkSession
        for k, v in debounce.STATE_STORE.items():
            spark.conf.set(k, v)
        spark.createDataFrame([], OUTCOME).write.mode("append").parquet(f"{self.home}/outcomes")
        outcomes = spark.readStream.schema(OUTCOME).parquet(f"{self.home}/outcomes")
        rows = debounce.flushes(changes, self.gap_ms, outcomes=outcomes, retry_ms=self.retry_ms)
        self.query = rows.writeStream.outputMode("append").option("checkpointLocation", f"{self.home}/checkpoint").trigger(processingTime=every).foreachBatch(self.batch).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def health(self) -> dict:
        active = bool(self.query is not None and self.query.isActive)
        return {"active": active, "scans": self.scans, "failures": self.failures, "recoveries": self.recoveries, "recovery_pending": self.pending, "last_error": self.last_error}
