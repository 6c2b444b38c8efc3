"""Shared pieces of the training-data operators.

Nothing here collects documents to the driver. Lineage is cut only with a
reliable ``checkpoint()`` into the shared folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Java regex of a word: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised kernel call works on at a time.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; set one only where none is set."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="symbolith-checkpoint-"))
    else:
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver's JVM give back broadcasts, plans and generated classes that nothing refers to any more.

    Operators of many small jobs leave these behind with every step, and the heap grows to its limit before it is tidied.
    """
    spark.sparkContext._jvm.System.gc()


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        out.append(n)
    return out


# --- Rows --------------------------------------------------------------------

#: Narrow rows (some twenty bytes each) that are broadcast at most; beyond it sides are dealt by key.
BROADCAST_ROWS = 250_000


def row_key(id_col: str, text_col: str) -> Column:
    """With the id, what tells rows apart: rows of equal id and text are twins."""
    return F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))


def small(df: DataFrame) -> DataFrame:
    """``df``, materialised, with a hint to broadcast it if it has been counted to be small."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(df: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    own, key = fresh(df, "_row_id", "_row_key")
    keys = keys.select(F.col("id").alias(own), F.col("k").alias(key)).distinct()
    return df.join(small(keys), (row_key(id_col, text_col) == F.col(key)) & F.col(id_col).cast("long").eqNullSafe(F.col(own)), how)


def without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose (id, k) isn't in ``gone``."""
    return _keyed(df, gone, id_col, text_col, "left_anti")


def one_of_each(df: DataFrame, twins: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with one row of each (id, k) in ``twins``.

    Which row that is, is decided by its other columns; rows alike in all are interchangeable.
    """
    twins = materialize(twins)
    if twins.isEmpty():
        return df
    same = _keyed(df, twins, id_col, text_col, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = same.groupBy(F.col(id_col), F.col(text_col)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_one")).select("_one.*")
    return _keyed(df, twins, id_col, text_col, "left_anti").unionByName(one)


# --- Arrow kernels -----------------------------------------------------------


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column, one after another, and n+1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    buf = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes each, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


#: Arrays of so many bytes are mapped by themselves, so that what is freed goes back to the system at once.
MAPPED_BYTES = 1 << 20


def lean(kernel: Kernel) -> Kernel:
    """``kernel``, in a worker that keeps no memory that its task has freed.

    Workers stay for later tasks and stages; the C library would hold the most that they ever used, beside the
    executor's heap. Where the library isn't glibc, the kernel runs as it is.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD
        try:
            yield from kernel(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return task


def index_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one after another."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit of a uint64 over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row it stands in."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_SPACE[buf]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = word[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    prev[edge] = False
    starts = np.flatnonzero(word & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = word[1:]
    nxt[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(word & ~nxt) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased first if asked."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(buf)
    power, inverse = _powers(n + 1)
    value = _BYTE[_LOWER[buf] if lower else buf]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * power[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words; a shorter row is one run as a whole."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    runs = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    row = np.repeat(np.arange(n_rows), runs)
    at = np.repeat(first, runs) + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    length = np.minimum(counts, size)[row]
    out = length.astype(np.uint64)
    for k in range(size):
        use = k < length
        step = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.zeros(len(at), np.uint64)
        out = np.where(use, mix64(out * np.uint64(0xD6E8FEB86659FD93) + step + np.uint64(k + 1)), out)
    return out, row


# --- Graphs ------------------------------------------------------------------


EDGES_A_TASK = 1000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for each node on an edge; root is the smallest node it reaches.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014): each
    node's minimum comes from a pre-aggregated groupBy, so a hub costs one row per
    map task, and the number of edges never grows. Every round is checkpointed; only
    totals reach the driver. Edges are counted first: a task writes EDGES_A_TASK of them or
    more, so a small graph among many partitions doesn't leave many small files.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, state = e.count(), None
    tasks = 1 + n // EDGES_A_TASK
    while n:
        e = e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
        low = materialize(low) if tasks > 1 else low  # one task has no hub to split
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u")
        star = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = materialize(star.coalesce(tasks).distinct().coalesce(tasks))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
