"""Debounced flushes with a retry, and a bounded event log, as stateful operators with timers.

The state is in RocksDB, one key a project (``STATE_STORE`` is the setting for it). A flush's paths are a distinct set, so state is
bounded by the files of a project that change within a gap, and the log's by its limit.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RETRY_MS = 1000
FLUSH = "project string, flush long, attempt int, start timestamp, end timestamp, changes long, paths array<string>"
#: What goes in: changes (project, path, ts), and outcomes of flushes (project, flush, ok).
INPUT = "project string, path string, ts timestamp, flush long, ok boolean"

_EPOCH = datetime.datetime(1970, 1, 1)


def _ms(ts: datetime.datetime) -> int:
    if ts.tzinfo is not None:
        ts = ts.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return (ts - _EPOCH) // datetime.timedelta(milliseconds=1)


def _ts(ms: int) -> datetime.datetime:
    return _EPOCH + datetime.timedelta(milliseconds=ms)


def merged(sessions: list[tuple], gap: int) -> list[tuple]:
    """(start, last, changes, paths) of sessions, those no more than a gap apart as one."""
    out: list[tuple] = []
    for s in sorted(sessions, key=lambda s: s[0]):
        if out and s[0] <= out[-1][1] + gap:
            a = out.pop()
            s = (a[0], max(a[1], s[1]), a[2] + s[2], a[3] | s[3])
        out.append(s)
    return out


class Debounce(StatefulProcessor):
    """Trailing-edge debounce by project; a flush that failed comes once more after RETRY_MS.

    With ``event_time``, sessions are of the changes' own times and close by the watermark; otherwise a session is what arrives with
    no more than a gap between, by the clock, so the last one closes without further changes.
    """

    def __init__(self, gap_ms: int, event_time: bool, retry_ms: int = RETRY_MS):
        self.gap, self.event_time, self.retry = gap_ms, event_time, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, changes long, paths array<string>")
        self.waiting = handle.getMapState("waiting", "flush long", "attempt int, due long, start long, end long, changes long, paths array<string>")
        self.next = handle.getValueState("next", "flush long")

    def _sessions(self) -> list[tuple]:
        return [(r[0], r[1], r[2], frozenset(r[3])) for r in self.open.get()] if self.open.exists() else []

    def _keep(self, sessions: list[tuple]) -> None:
        if sessions:
            self.open.put([(a, b, n, sorted(paths)) for a, b, n, paths in sessions])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        fresh, paths_now, n_now = [], set(), 0
        for r in rows:
            if r["ok"] is not None:
                self._outcome(r["flush"], r["ok"], now)
            elif self.event_time:
                at = _ms(r["ts"])
                fresh.append((at, at, 1, frozenset([r["path"]])))
            else:
                paths_now.add(r["path"])
                n_now += 1
        if n_now:
            fresh.append((now, now, n_now, frozenset(paths_now)))
        if fresh:
            sessions = merged(self._sessions() + fresh, self.gap)
            self._keep(sessions)
            for _, last, _, _ in sessions:
                self.handle.registerTimer(last + self.gap)
        yield from ()

    def _outcome(self, flush: int, ok: bool, now: int) -> None:
        if not self.waiting.containsKey((flush,)):
            return
        attempt, _, *rest = self.waiting.getValue((flush,))
        if ok or attempt:
            self.waiting.removeKey((flush,))
        else:
            self.waiting.updateValue((flush,), (1, now + self.retry, *rest))
            self.handle.registerTimer(now + self.retry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        stay = []
        for start, last, n, paths in self._sessions():
            if last + self.gap > at:
                stay.append((start, last, n, paths))  # a later change has a timer of its own
                continue
            number = self.next.get()[0] if self.next.exists() else 0
            self.next.update((number + 1,))
            flush = (start, last + self.gap, n, sorted(paths))
            if not self.event_time:
                self.waiting.updateValue((number,), (0, 0, *flush))
            yield self._row(key, number, 0, *flush)
        self._keep(stay)
        due = [(k[0], v) for k, v in self.waiting.iterator() if v[0] == 1 and 0 < v[1] <= at] if self.waiting.exists() else []
        for number, (_, _, *flush) in due:
            self.waiting.updateValue((number,), (1, 0, *flush))
            yield self._row(key, number, 1, *flush)

    def _row(self, key, number: int, attempt: int, start: int, end: int, n: int, paths: list[str]) -> Row:
        return Row(project=key[0], flush=number, attempt=attempt, start=_ts(start), end=_ts(end), changes=n, paths=list(paths))

    def close(self) -> None:
        pass


def as_input(changes: DataFrame) -> DataFrame:
    return changes.select("project", "path", "ts", F.lit(None).cast("long").alias("flush"), F.lit(None).cast("boolean").alias("ok"))


def outcomes_as_input(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("project", F.lit(None).cast("string").alias("path"), F.lit(None).cast("timestamp").alias("ts"), "flush", "ok")


def flushes(changes: DataFrame, gap_ms: int = 600, late: str | None = None, outcomes: DataFrame | None = None, retry_ms: int = RETRY_MS) -> DataFrame:
    """Flushes of a stream of changes (project, path, ts), by the clock, or with ``late`` by event time.

    outcomes: a stream (project, flush, ok) of how flushes went; one that failed is emitted once more.
    """
    if late:
        rows = as_input(changes.withWatermark("ts", late))
        return rows.groupBy("project").transformWithState(Debounce(gap_ms, True), FLUSH, "Append", "EventTime")
    rows = as_input(changes)
    if outcomes is not None:
        rows = rows.unionByName(outcomes_as_input(outcomes))
    return rows.groupBy("project").transformWithState(Debounce(gap_ms, False, retry_ms), FLUSH, "Append", "ProcessingTime")


class EventLog(StatefulProcessor):
    """Numbers a project's events in the order (ts, seq) of each batch and keeps the newest ``limit`` of them.

    Numbers are given by the state, so no two events of a project share one, whoever appends.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")
        self.kept = handle.getListState("kept", "seq long, symbol string, file string, type string, ts timestamp")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq = self.last.get()[0] if self.last.exists() else 0
        kept = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
            seq += 1
            kept.append((seq, r["symbol"], r["file"], r["type"], r["ts"]))
        kept = kept[-self.limit :]
        self.last.update((seq,))
        self.kept.put(kept)
        for row in kept:
            yield Row(project=key[0], seq=row[0], symbol=row[1], file=row[2], type=row[3], ts=row[4])

    def close(self) -> None:
        pass


LOG = "project string, seq long, symbol string, file string, type string, ts timestamp"


def event_log(events: DataFrame, limit: int = 500) -> DataFrame:
    """The kept events of each project that had new ones in a batch; events: (project, symbol, file, type, ts, seq).

    A batch's rows of a project are cut to its newest ``limit`` by a rank before they reach its state only where the source bounds
    the batch; state itself never holds more than ``limit`` events.
    """
    return events.groupBy("project").transformWithState(EventLog(limit), LOG, "Update", "None")
