"""Suffix-array dedup: remove bytes covered by a string of ``LENGTH`` bytes that occurs again.

A sparse, distributed suffix array. A suffix is sorted only where it starts at an *anchor*:
the leftmost ``GRAM``-byte string of least hash inside a window of ``LENGTH`` bytes. Equal
windows have equal anchors at equal offsets, so nothing is lost, and only about one
position in sixty is moved. The windows of one anchor are a run of starts; the bytes that
they cover are the anchor's *segment*.

1. **Deal.** Splitters are sampled from the leading bytes of anchor suffixes. Each suffix
   goes to the range of its leading bytes, without its bytes. Equal segments of a batch are
   combined first, after comparing their bytes, and marked. A range so common that several
   splitters are equal is spread over those ranges.
2. **Sieve.** Ranges are sorted by leading bytes and anchor. An anchor that stands once has
   no equal and ends here; hashes decide nothing else.
3. **Sort.** The bytes of the other segments are fetched and dealt by the same splitters.
   Each range is sorted by leading bytes and anchor; in it equal segments are combined and
   windows of one anchor and offset are sorted by multikey quicksort, eight bytes a round: parts
   of one window are dropped, and what is left after the last round is equal in every byte.
   Splitters part suffixes by leading bytes, equal ones by the whole anchor, so suffixes on
   both sides of a boundary have less than ``GRAM`` bytes in common: none of their windows
   are equal, and each range's ends are settled by the deal.
4. **Hot anchors.** An anchor with more than ``HOT_SEGMENTS`` segments (of different batches
   or contexts) is taken window by window: equal windows of a batch are combined, 128-bit hashes
   of the others are counted, and only windows whose hash several batches have are fetched
   and sorted as above. A group has a row for each batch at most, not for each context.
5. **Cut.** Covered intervals are collected per document (as many as its own length
   allows), merged and cut out.

Texts are joined by document on exchanges that adaptive execution can split; step 1 moves
about fifty bytes an anchor. Only the leading bytes of about ``SAMPLE_ROWS`` documents'
anchors, 1,024 of one at most, reach the driver.

Defined cases: a null text is empty; a text of fewer than LENGTH bytes loses nothing;
overlapping occurrences in one text count; a row that repeats another's text is another
occurrence, whatever its id (rows of equal id and text are read once, and lose all their
bytes if they have LENGTH); null ids are kept as they are; extra columns are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, index_ranges, materialize, mix64, pieces, small, string_buffer, text_of

LENGTH = 200
GRAM = 64
TOKEN = 8  # bytes of a token of the multikey quicksort; LENGTH is a multiple of it
PIECE = 1 << 19
LONG = 4 << 20  # window starts of a piece of a longer text; positions in a piece must fit in POSITION bits
POSITION = 24
SAMPLE_ROWS = 2000
RANGES_PER_PARTITION = 8
HOT_SEGMENTS = 20_000
GATHER = 4 << 20

_C = np.uint64(0xD6E8FEB86659FD93)


def _double(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of runs, from those of their first part and of the part ``step`` later."""
    out = h[:-step] * _C
    out += h[step:]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    return out


class Anchors:
    """Anchors of all windows in a buffer of several rows, of fewer than 2**POSITION bytes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        none = np.zeros(0, np.int64)
        self.row = self.start = self.size = self.off = none
        self.gram = self.segment = self.lead = np.zeros(0, np.uint64)
        n = len(buf)
        if n >> POSITION:
            raise ValueError(f"{n} bytes don't fit in {POSITION} bits")
        lengths = np.diff(offsets)
        windows = np.maximum(lengths - LENGTH + 1, 0)
        if windows.sum() == 0:
            return
        h = _BYTE[buf]
        for step in (1, 2, 4, 8, 16, 32):
            h = _double(h, step)
        low = (h & ~np.uint64((1 << POSITION) - 1)) | np.arange(len(h), dtype=np.uint64)  # leftmost of equals
        span, step = LENGTH - GRAM + 1, 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if span > step:
            low = np.minimum(low[: step - span], low[span - step :])
        long = _double(h, 64)
        whole = _double(long, LENGTH - 128) if n >= LENGTH else long[:0]
        row = np.repeat(np.arange(len(lengths)), windows)
        at = np.arange(len(row)) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
        anchor = (low[at] & np.uint64((1 << POSITION) - 1)).astype(np.int64)
        cut = np.empty(len(at), bool)
        cut[0] = True
        cut[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(at)) - 1
        s, e, a = at[first], at[last], anchor[first]
        self.row, self.off = row[first], a - s
        self.start, self.size = s - offsets[self.row], e - s + LENGTH
        self.gram = h[a]
        self.segment = mix64(whole[s] * _C + whole[e] + mix64((self.off * 4096 + self.size).astype(np.uint64)))
        self.lead = buf[a[:, None] + np.arange(8)].astype(">u1").view(">u8").ravel().astype(np.uint64) if len(a) else self.lead


def anchors(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, Anchors]]:
    """First row, place in that row and anchors of each piece of the rows.

    A row longer than LONG is cut in pieces that overlap by LENGTH - 1 bytes, so each window
    is in exactly one. A segment that is cut there counts as two segments of its anchor.
    """
    for i, j in pieces(off, PIECE):
        a, z = int(off[i]), int(off[j])
        if z - a <= max(PIECE, LONG):
            yield i, 0, Anchors(buf[a:z], off[i : j + 1] - a)
            continue
        for at in range(a, z - LENGTH + 1, LONG):
            part = buf[at : min(at + LONG + LENGTH - 1, z)]
            yield i, at - a, Anchors(part, np.array([0, len(part)]))


def _unlike(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which runs at ``a`` differ from those at ``b`` in some byte."""
    out = np.zeros(len(a), bool)
    for i, j in pieces(np.concatenate(([0], np.cumsum(size))), PIECE):
        n = size[i:j]
        differs = buf[index_ranges(a[i:j], n)] != buf[index_ranges(b[i:j], n)]
        out[i:j] = np.logical_or.reduceat(differs, np.cumsum(n) - n)
    return out


def alike(buf: np.ndarray, at: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each run and first run of each group; runs of a group are equal byte by byte.

    ``keys`` are hashes that equal runs share; runs that merely share them are told apart.
    """
    extra = np.zeros(len(at), np.int64)
    while True:
        by = (extra, *keys) if extra.any() else keys
        order = np.lexsort(by)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in by:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        group = np.cumsum(new) - 1
        first = order[new]
        rest = np.flatnonzero(~new)
        own, its = order[rest], first[group[rest]]
        wrong = size[own] != size[its]
        fit = np.flatnonzero(~wrong)
        wrong[fit] = _unlike(buf, at[own[fit]], at[its[fit]], size[own[fit]])
        if not wrong.any():
            out = np.empty(len(order), np.int64)
            out[order] = group
            return out, first
        extra[own[wrong]] += 1


def _ordered(lead: np.ndarray) -> np.ndarray:
    """Leading bytes as longs that sort like the bytes."""
    return (lead ^ np.uint64(1 << 63)).view(np.int64)


def range_of(cuts: np.ndarray, lead: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of each suffix, and whether its leading bytes have several; then ``tie`` picks one."""
    lo, hi = np.searchsorted(cuts, lead, side="left"), np.searchsorted(cuts, lead, side="right")
    return lo + (tie % (hi - lo + 1).astype(np.uint64)).astype(np.int64), hi > lo


DEAL = "pid int, kind int, lead long, gram long, k1 long, k2 long, start int, size int, off int, many boolean, spread boolean"
_DEAL_NAMES = [x.split()[0] for x in DEAL.split(", ")]
_DEAL_KINDS = (np.int32, np.int32, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, bool, bool)


def _record(names: list[str], kinds: tuple, cols: tuple) -> pa.RecordBatch:
    n = max(np.size(c) for c in cols if not np.isscalar(c))
    return pa.RecordBatch.from_arrays([pa.array((np.full(n, c) if np.isscalar(c) else np.asarray(c)).astype(t, copy=False)) for c, t in zip(cols, kinds)], names)


def _deal(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = np.asarray(b.column(0)), np.asarray(b.column(1))
            buf, off = string_buffer(b.column(2))
            got: list[list[np.ndarray]] = []
            for i, base, a in anchors(buf, off):
                got.append([a.row + i, a.start + base, a.size, a.off, a.gram, a.segment, a.lead])
            if not got:
                continue
            row, start, size, offset, gram, segment, lead = (np.concatenate(x) for x in zip(*got))
            if not len(row):
                continue
            group, one = alike(buf, off[row] + start, size, segment)
            weight = np.bincount(group)
            pid, spread = range_of(cuts, lead[one], segment[one])
            r = row[one]
            yield _record(
                _DEAL_NAMES, _DEAL_KINDS, (pid, 1, _ordered(lead[one]), gram[one].view(np.int64), k1[r], k2[r], start[one], size[one], offset[one], weight > 1, spread)
            )
            at = np.flatnonzero(weight[group] > 1)
            if len(at):
                r, s, e = merge(row[at], start[at], start[at] + size[at])
                pid = (k1[r].astype(np.uint64) % np.uint64(len(cuts) + 1)).astype(np.int64)
                yield _record(_DEAL_NAMES, _DEAL_KINDS, (pid, 0, 0, 0, k1[r], k2[r], s, e - s, 0, False, False))

    return run


def merge(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of the union, by row; touching intervals are one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order].astype(np.int64)
    if not len(row):
        return row, start, end
    shift = (row - row[0]).astype(np.int64) if np.issubdtype(row.dtype, np.integer) else row
    rank = np.cumsum(np.append(0, np.diff(shift) != 0))
    room = int(end.max()) + 2
    reach = np.maximum.accumulate(end + rank * room)
    new = np.ones(len(row), bool)
    new[1:] = start[1:] + rank[1:] * room > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], (reach - rank * room)[last]


def _in_chunks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int, weigh: str | None = None) -> Iterator[pa.Table]:
    """Sorted batches gathered to about ``rows`` rows (or bytes of a column), cut where a key changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(b.schema.get_field_index(weigh)).nbytes if weigh else b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held)
        change = np.zeros(len(t) - 1, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        if len(at):
            cut = int(at[-1]) + 1
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).combine_chunks().to_batches()
            size = 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


SIEVED = "kind int, gram long, k1 long, k2 long, start int, size int, off int, many boolean"
_SIEVED_NAMES = [x.split()[0] for x in SIEVED.split(", ")]


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops anchors that stand once."""
    for t in _in_chunks(batches, ("kind", "lead", "gram"), 200_000):
        new = np.ones(len(t), bool)
        new[1:] = False
        for k in ("kind", "lead", "gram"):
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        stay = several | (t.column("kind").to_numpy() == 0) | t.column("spread").to_numpy(zero_copy_only=False)
        yield from t.filter(pa.array(stay)).select(_SIEVED_NAMES).to_batches()


FETCHED = "pid int, lead long, gram long, k1 long, k2 long, start int, off int, many boolean, bytes binary"
_FETCHED_NAMES = [x.split()[0] for x in FETCHED.split(", ")]


def _wanted(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Text bytes, place in them of each wanted run, and the fields of the runs with their document's keys."""
    buf, off = string_buffer(b.column(0))
    lists = b.column(3)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    runs = lists.flatten()
    c = {runs.type.field(i).name: runs.field(i).to_numpy(zero_copy_only=False) for i in range(runs.type.num_fields)}
    c |= {"k1": np.asarray(b.column(1))[row], "k2": np.asarray(b.column(2))[row]}
    return buf, off[row] + c["start"], c


def _lead_of(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return buf[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


def _fetch(cuts: np.ndarray):
    """Bytes of segments, dealt by the leading bytes of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at, c = _wanted(b)
            sizes = np.concatenate(([0], np.cumsum(c["size"])))
            for i, j in pieces(sizes, GATHER):
                lead = _lead_of(buf, at[i:j] + c["off"][i:j])
                pid, _ = range_of(cuts, lead, mix64(c["gram"][i:j].view(np.uint64)))
                data = buf[index_ranges(at[i:j], c["size"][i:j].astype(np.int64))]
                runs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((sizes[i : j + 1] - sizes[i]).astype(np.int32)), pa.py_buffer(data)])
                cols = [pid.astype(np.int32), _ordered(lead), *(c[k][i:j] for k in ("gram", "k1", "k2", "start", "off", "many"))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), runs], _FETCHED_NAMES)

    return run


WINDOWS = "kind int, w1 long, w2 long, k1 long, k2 long, start int, size int, off int, many boolean"
_WINDOWS_NAMES = [x.split()[0] for x in WINDOWS.split(", ")]
_WINDOWS_KINDS = (np.int32, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, bool)


def _window_hashes(buf: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the windows at ``at``, from hashes of runs of eight bytes."""
    h = mix64(_BYTE[buf] ^ np.uint64(seed))
    for step in (1, 2, 4):
        h = _double(h, step)
    out = np.zeros(len(at), np.uint64)
    for k in range(0, LENGTH, 8):
        out = mix64(out * _C + h[at + k])
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of hot segments as 128-bit hashes, one of each distinct window of a batch (kind 1), and what repeats in a batch (kind 0)."""
    for b in batches:
        buf, place, c = _wanted(b)
        for i, j in pieces(np.concatenate(([0], np.cumsum(c["size"]))), PIECE):
            n = c["size"][i:j].astype(np.int64) - LENGTH + 1
            seg = np.repeat(np.arange(i, j), n)
            inside = index_ranges(np.zeros(j - i, np.int64), n)
            at = place[seg] + inside
            low = int(at.min())
            own = buf[low : int(at.max()) + LENGTH]
            w = [_window_hashes(own, at - low, k) for k in (1, 2)]
            group, one = alike(buf, at, np.full(len(at), LENGTH), *w)
            many = np.bincount(group) > 1
            start, k1, k2 = c["start"][seg] + inside, c["k1"][seg], c["k2"][seg]
            yield _record(
                _WINDOWS_NAMES, _WINDOWS_KINDS,
                (1, w[0][one].view(np.int64), w[1][one].view(np.int64), k1[one], k2[one], start[one], LENGTH, (c["off"][seg] - inside)[one], many),
            )
            hit = np.flatnonzero(many[group])
            if len(hit):
                r, s, e = merge(seg[hit], start[hit].astype(np.int64), start[hit].astype(np.int64) + LENGTH)
                yield _record(_WINDOWS_NAMES, _WINDOWS_KINDS, (0, 0, 0, c["k1"][r], c["k2"][r], s, e - s, 0, False))


def _words(buf: np.ndarray) -> np.ndarray:
    """The TOKEN bytes from each position as a number that sorts like them; zeros stand behind the end."""
    long = np.concatenate([buf, np.zeros(TOKEN, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for k in range(TOKEN):
        out = (out << np.uint64(8)) | long[k : k + len(buf)]
    return out


def equal_windows(buf: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows equal another of their group: multikey quicksort, TOKEN bytes a round.

    Each round sorts those parts in which the next token differs, and drops parts of one
    window. After the last round the windows of a part are equal in all LENGTH bytes.
    """
    word = _words(buf)
    live = np.argsort(group, kind="stable")
    part = group[live]
    for depth in range(LENGTH // TOKEN):
        new = np.ones(len(live), bool)
        new[1:] = part[1:] != part[:-1]
        part = np.cumsum(new) - 1
        stay = np.bincount(part)[part] > 1 if len(part) else new
        live, part, new = live[stay], part[stay], new[stay]
        t = word[at[live] + depth * TOKEN]
        differs = np.zeros(int(part[-1]) + 1 if len(part) else 0, bool)
        differs[part[1:][(t[1:] != t[:-1]) & ~new[1:]]] = True
        mixed = np.flatnonzero(differs[part])
        order = mixed[np.lexsort((t[mixed], part[mixed]))]
        live[mixed], t[mixed] = live[order], t[order]
        split = np.zeros(len(live), bool)
        split[1:] = (part[1:] != part[:-1]) | (t[1:] != t[:-1])
        part = np.cumsum(split)
    out = np.zeros(len(at), bool)
    if len(part):
        out[live[np.bincount(part)[part] > 1]] = True
    return out


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered intervals from the segments of a range, sorted by leading bytes and anchor."""
    for t in _in_chunks(batches, ("lead", "gram"), GATHER, "bytes"):
        col = t.column("bytes").combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0)
        off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
        buf = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        change = np.zeros(len(t), bool)
        for k in ("lead", "gram"):
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        anchor, key, size = t.column("off").to_numpy().astype(np.int64), np.cumsum(change), np.diff(off)
        same, one = alike(buf, off[:-1], size, _first_and_last(buf, off), key * 4096 + anchor)
        copies = np.bincount(same)[same] > 1
        several = np.bincount(key[one], minlength=int(key[-1]) + 1) > 1  # anchors with different segments
        one = one[several[key[one]]]
        n = size[one] - LENGTH + 1
        seg = np.repeat(one, n)
        inside = index_ranges(np.zeros(len(one), np.int64), n)
        equal = equal_windows(buf, off[seg] + inside, key[seg] * 4096 + (anchor[seg] - inside))
        many = t.column("many").to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(equal & ~many[seg] & ~copies[seg])
        whole = np.flatnonzero(copies & ~many)
        r, s, e = merge(np.concatenate([seg[hit], whole]), np.concatenate([inside[hit], np.zeros(len(whole), np.int64)]), np.concatenate([inside[hit] + LENGTH, size[whole]]))
        cols = [t.column("k1").to_numpy()[r], t.column("k2").to_numpy()[r], (t.column("start").to_numpy()[r] + s).astype(np.int32), (e - s).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["k1", "k2", "start", "size"])


def _first_and_last(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of the outer bytes of each segment."""
    a, b = (buf[x[:, None] + np.arange(8)].view(np.uint64).ravel() for x in (off[:-1], off[1:] - 8))
    return mix64(a * _C + b)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_out(data: bytes, covers: list[int] | None) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal covered spans and the bytes that are left."""
    if not covers:
        return [], data
    c = np.asarray(covers, np.int64)
    _, s, e = merge(np.zeros(len(c), np.int64), c >> 32, (c >> 32) + (c & 0xFFFFFFFF))
    spans = list(zip(s.tolist(), e.tolist()))
    left, at = [], 0
    for a, b in spans:
        left.append(data[at:a])
        at = b
    return spans, b"".join([*left, data[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for doc, text, covers in zip(b.column(0), b.column(1), b.column(2)):
            data = text.as_py().encode()
            spans, left = cut_out(data, covers.as_py())
            rows.append((doc.as_py(), len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [x.split()[0] for x in RESULT.split(", ")])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text, covers in zip(b.column(0), b.column(1), b.column(2)):
            spans, left = cut_out(text.as_py().encode(), covers.as_py())
            rows.append((doc.as_py(), left, [{"start": s, "end": e} for s, e in spans]))
        cols = list(zip(*rows)) if rows else [[]] * 3
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.binary(), span))], ["doc_id", "bytes", "spans"])


def _splitters(texts: DataFrame, ranges: int, seed: int) -> np.ndarray:
    """Equal-depth splitters of the leading bytes of sampled anchor suffixes."""
    n = texts.count()
    if n == 0:
        return np.zeros(0, np.uint64)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = string_buffer(b.column(0))
            for _, _, a in anchors(buf, off):
                yield pa.RecordBatch.from_arrays([pa.array(a.lead[::8][:1024].view(np.int64))], ["lead"])

    rows = texts.select("text").sample(min(1.0, SAMPLE_ROWS / n), seed).mapInArrow(leads, "lead long").collect()
    lead = np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    return lead[(np.arange(1, ranges) * len(lead)) // ranges] if len(lead) else lead


def _in_ranges(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    """Rows in partitions of neighbouring ranges, sorted."""
    own = F.least((F.col("pid") / RANGES_PER_PARTITION).cast("int"), F.lit(parts - 1))
    return rows.withColumn("pid", own).repartitionById(parts, "pid").sortWithinPartitions(*order)


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 9) -> DataFrame:
    """Rows (_id, k1, k2, text, covers) of ``docs``; covers holds (start << 32) + size of covered intervals."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("text"))
    texts = texts.select(
        "_id", F.xxhash64("_id", "text").alias("k1"), F.coalesce("_id", F.lit(-(2**63))).alias("k2"), "text"
    )
    # rows of equal id and text: one of them stands for all, whose bytes all stand elsewhere too
    every, keys = texts, ["k1", "k2"]
    twins = small(texts.groupBy(*keys).count().where("count > 1").select(*keys, F.lit(True).alias("twin")))
    if any_twins := not twins.isEmpty():
        one = texts.join(twins, keys, "left_semi").groupBy(*keys).agg(F.first("_id").alias("_id"), F.first("text").alias("text"))
        texts = texts.join(twins, keys, "left_anti").unionByName(one)
    cuts = _splitters(texts, parts * RANGES_PER_PARTITION, seed)
    dealt = texts.select("k1", "k2", "text").mapInArrow(_deal(cuts), DEAL)
    sieved = materialize(_in_ranges(dealt, parts, "kind", "lead", "gram").mapInArrow(_sieve, SIEVED))
    on = sieved.where("kind = 1")
    covers = [sieved.where("kind = 0").select("k1", "k2", "start", "size")]

    def texts_of(runs: DataFrame) -> DataFrame:
        wanted = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "start", "size", "off", "many")).alias("wanted"))
        # with the columns of the join below, so that both read one exchange of the texts
        return texts.join(wanted, ["k1", "k2"]).select("text", "k1", "k2", "wanted", "_id")

    def equals(runs: DataFrame) -> DataFrame:
        fetched = texts_of(runs).mapInArrow(_fetch(cuts), FETCHED)
        return _in_ranges(fetched, parts, "lead", "gram").mapInArrow(_sort, "k1 long, k2 long, start int, size int")

    hot = materialize(on.groupBy("gram").count().where(F.col("count") > HOT_SEGMENTS).select("gram"))
    if hot.isEmpty():
        covers.append(equals(on))
    else:
        covers.append(equals(on.join(hot, "gram", "left_anti")))
        windows = materialize(texts_of(on.join(hot, "gram", "left_semi")).mapInArrow(_windows, WINDOWS))
        covers.append(windows.where("kind = 0").select("k1", "k2", "start", "size"))
        own = windows.where("kind = 1")
        several = materialize(own.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"))
        covers.append(equals(own.join(several, ["w1", "w2"]).withColumnRenamed("w1", "gram")))
    code = F.shiftleft(F.col("start").cast("long"), 32) + F.col("size")
    found = covers[0]
    for more in covers[1:]:
        found = found.unionByName(more)
    found = found.groupBy("k1", "k2").agg(F.collect_list(code).alias("covers"))
    out = every.join(found, keys, "left")
    if not any_twins:
        return out.select("_id", "k1", "k2", "text", "covers")
    size = F.octet_length("text")
    whole = F.when(size >= LENGTH, F.array(size.cast("long")))
    out = out.join(twins, keys, "left")
    return out.select("_id", "k1", "k2", "text", F.when(F.col("twin"), whole).otherwise(F.col("covers")).alias("covers"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    return covered(docs, **options).select("_id", "text", "covers").mapInArrow(_digest, RESULT)


def clean(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, bytes that are left, removed spans) of each row."""
    kinds = "doc_id long, bytes binary, spans array<struct<start:bigint,end:bigint>>"
    return covered(docs, **options).select("_id", "text", "covers").mapInArrow(_cleaned, kinds)
