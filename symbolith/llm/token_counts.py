"""Edit-aware token counts: a segment tree of pre-token runs per document.

A text is cut into leaves of about ``LEAF`` bytes at *safe* places: before a space between two
visible ASCII characters. The pre-token pattern always starts a pre-token there and looks at
nothing beyond, so leaves are encoded apart and their counts add up. The counts are the
leaves of a segment tree of subtree sums, stored as an array in heap order.

An edit touches the leaves it meets and, as boundary context, a neighbour whose safe place
lies within two bytes of it. Those leaves are joined, edited and encoded again, cut into as
many leaves as before (some may be empty), and only the sums above them are updated. All
other counts are reused.

The vocabulary's path is a parameter; its ranks, a file of fixed size, are broadcast. All work
is a map over documents; edits of a document are joined to it by id and are as many as its
own edits.

Defined cases: null and empty texts have 0 tokens and one empty leaf; edits are byte ranges of
the text before any edit, applied in order of start; overlapping edits, edits beyond the end or
inside a character are errors; edits of unknown ids are ignored; rows with a null
id have no edits; rows that repeat an id are told apart by their texts, each keeps its own tree
and takes the id's edits; twins of equal id and text share a tree; extra columns are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, text_of

LEAF = 1024
SAFE = re.compile(rb"(?<=[\x21-\x7e]) (?=[\x21-\x7e])")
DIGITS = re.compile(rb"[0-9]+")

Edit = tuple[int, int, bytes]


def default_vocabulary() -> tuple[str, str]:
    """Path of the byte-level vocabulary and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def load(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """Broadcast of (pattern, ranks) for the workers."""
    own, its = default_vocabulary() if path is None else (path, pattern)
    with open(own, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return spark.sparkContext.broadcast((its, ranks))


_built: dict[int, tuple[object, Callable[[bytes], int]]] = {}


def counter(shared) -> Callable[[bytes], int]:
    """Number of tokens of some UTF-8 bytes; built once in each worker."""
    key = id(shared.value)  # one object a worker, held below, so that its number isn't given again
    if key not in _built:
        import tiktoken

        pattern, ranks = shared.value
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _built[key] = shared.value, lambda data: len(encoding.encode_ordinary(data.decode()))
    return _built[key][1]


def safe_cuts(data: bytes, step: int) -> list[int]:
    """Starts of leaves of at least ``step`` bytes, 0 first."""
    out, at = [0], step
    while at < len(data):
        m = SAFE.search(data, at)
        if m is None:
            break
        out.append(m.start())
        at = m.start() + step
    return out


class Tree:
    """Leaf starts and, in heap order, sums of their token counts."""

    def __init__(self, starts: list[int], sums: list[int], size: int):
        self.starts, self.sums, self.size = starts, sums, size

    @classmethod
    def build(cls, data: bytes, count: Callable[[bytes], int], leaf: int = LEAF) -> Tree:
        starts = safe_cuts(data, leaf)
        width = 1 << (len(starts) - 1).bit_length()
        sums = [0] * (2 * width)
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)])):
            sums[width + k] = count(data[a:b])
        for k in range(width - 1, 0, -1):
            sums[k] = sums[2 * k] + sums[2 * k + 1]
        return cls(starts, sums, len(data))

    @property
    def total(self) -> int:
        return self.sums[1]

    def _touched(self, edits: list[Edit]) -> list[tuple[int, int]]:
        """Runs of leaves (first, last) that the edits and their context meet."""
        runs: list[list[int]] = []
        for s, e, _ in edits:
            first = bisect_right(self.starts, max(s - 2, 0)) - 1
            last = bisect_right(self.starts, min(e + 2, max(self.size - 1, 0))) - 1
            while first > 0 and self.starts[first] == self.starts[first - 1]:
                first -= 1
            if runs and first <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([first, last])
        return [(a, b) for a, b in runs]

    def edit(self, data: bytes, edits: list[Edit], count: Callable[[bytes], int]) -> tuple[bytes, int]:
        """Apply sorted edits; returns the new bytes and how many of them were encoded."""
        edits = sorted(edits, key=lambda x: x[:2])
        if any(b[0] < a[1] for a, b in zip(edits, edits[1:])) or any(not 0 <= s <= e <= self.size for s, e, _ in edits):
            raise ValueError("edits overlap or leave the text")
        if not edits:
            return data, 0
        ends = [*self.starts[1:], self.size]
        width, k, shift, done, parts, encoded = len(self.sums) // 2, 0, 0, 0, [], 0
        starts = list(self.starts)
        dirty: set[int] = set()
        for first, last in self._touched(edits):
            a, b = self.starts[first], ends[last]
            for j in range(done, first):
                starts[j] += shift
            part, at = [], a
            while k < len(edits) and edits[k][0] <= b and (edits[k][1] <= b):
                s, e, new = edits[k]
                part += [data[at:s], new]
                at, k = e, k + 1
            region = b"".join([*part, data[at:b]])
            cuts = safe_cuts(region, max(1, -(-len(region) // (last - first + 1))))[: last - first + 1]
            cuts += [len(region)] * (last - first + 1 - len(cuts))
            for j, (x, y) in enumerate(zip(cuts, [*cuts[1:], len(region)])):
                starts[first + j] = a + shift + x
                self.sums[width + first + j] = count(region[x:y])
                dirty.add((width + first + j) >> 1)
            encoded += len(region)
            parts += [data[(self.starts[done] if done < len(self.starts) else self.size) : a], region]
            shift += len(region) - (b - a)
            done = last + 1
        for j in range(done, len(starts)):
            starts[j] += shift
        parts.append(data[self.starts[done] :] if done < len(self.starts) else b"")
        while dirty and dirty != {0}:
            for j in dirty - {0}:
                self.sums[j] = self.sums[2 * j] + self.sums[2 * j + 1]
            dirty = {j >> 1 for j in dirty if j > 1}
        new = b"".join(parts)
        self.starts, self.size = starts, len(new)
        return new, encoded


def mask_digits(data: bytes) -> list[Edit]:
    """Edits that put one 0 for each run of digits."""
    return [(m.start(), m.end(), b"0") for m in DIGITS.finditer(data)]


TREES = "doc_id long, k long, n_bytes long, n_tokens long, starts array<int>, sums array<int>"
EDITED = "doc_id long, text string, n_tokens long, n_tokens_edited long, n_edits long, n_bytes_encoded long, starts array<int>, sums array<int>"
COUNTS = "doc_id long, n_bytes long, n_tokens long, n_edits long, n_bytes_encoded long, n_tokens_edited long"
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, k in zip(cols, kinds)], list(names))


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), row_key(id_col, text_col).alias("k"))


def trees(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's segment tree, to be kept beside the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared)
        for b in batches:
            out = []
            for doc, text, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                t = Tree.build(text.as_py().encode(), count)
                out.append((doc, k, t.size, t.total, t.starts, t.sums))
            yield _rows(TREES, out)

    return _docs(docs, id_col, text_col).mapInArrow(run, TREES)


def apply_edits(docs: DataFrame, kept: DataFrame, edits: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New texts, trees and counts after ``edits`` (doc_id, start, end, replacement), from kept trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared)
        for b in batches:
            out = []
            for r in b.to_pylist():
                t, data = Tree(r["starts"], r["sums"], r["n_bytes"]), r["text"].encode()
                own = [(e["start"], e["end"], (e["replacement"] or "").encode()) for e in r["edits"] or []]
                new, encoded = t.edit(data, own, count)
                out.append((r["doc_id"], new.decode(), r["n_tokens"], t.total, len(own), encoded, t.starts, t.sums))
            yield _rows(EDITED, out)

    by_doc = edits.groupBy(F.col("doc_id").alias("_e")).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    kept = kept.dropDuplicates(["doc_id", "k"]).withColumnsRenamed({"doc_id": "_t", "k": "_k"})
    rows = _docs(docs, id_col, text_col).join(kept, (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_t")))
    rows = rows.join(by_doc, F.col("doc_id") == F.col("_e"), "left")
    return rows.select("doc_id", "text", "n_bytes", "n_tokens", "starts", "sums", "edits").mapInArrow(run, EDITED)


def counts(docs: DataFrame, shared, edits_of: Callable[[bytes], list[Edit]] = mask_digits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of each row before and after the edits that ``edits_of`` makes of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = text.as_py().encode()
                t = Tree.build(data, count)
                edits, size, before = edits_of(data), t.size, t.total
                _, encoded = t.edit(data, edits, count)
                out.append((doc, size, before, len(edits), encoded, t.total))
            yield _rows(COUNTS, out)

    return _docs(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, COUNTS)
