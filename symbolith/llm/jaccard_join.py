"""N-gram Jaccard join by grouped prefixes, giving connected components of similar texts.

Texts are sets of word shingles; equal sets are one *class*. Shingles are ordered by document
frequency, rare first (the frequency comes from a counting sketch over all documents whose
size is bounded, so ties and collisions cost time, never links). Two linked sets share ``c``
shingles of their prefixes of ``n - ceil(t n) + c`` shingles; c is 1 for short sets and grows
with the size, so long texts that have a few rare shingles in common are no pair.

1. **Group.** Classes of equal size and prefix are one group; the group, not its members, is
   joined. A thousand copies are one row per map task.
2. **Pivots.** Of the groups that share a prefix shingle, the one whose shingles are commonest
   is the pivot; of a group, its first member. Of the pivots that size and parity allow, each
   class is verified against the commonest: one pair a class. The verified links give first
   components.
3. **Group pairs.** Of each prefix shingle the groups outside its largest component are joined
   with all its groups; pairs of one component are never made, so a large class of near copies
   costs what its outsiders cost. Pairs are filtered by size and by parity: a set's 512-bit
   parity map differs from another's in at most as many bits as they differ in shingles. Pairs
   with the smaller of their two ``c`` of common prefix shingles stay.
4. **Expand and verify.** Group pairs are expanded to pairs of classes of different components,
   filtered by parity again, and decided by the exact intersection. No link that could join
   two components is left out.
5. Components of all links give each document's smallest reachable id.

Rows are told apart by id and text, classes by 128 bits; nodes of the graph are 64 of them.
Small aggregates that meet a hot key are materialised first, so adaptive execution can
split the other side. Pairs of sets that are nearly linked, but aren't, are still looked at one
by one: among m such sets with common prefixes the parity filter makes m * m comparisons.

Defined cases: null and empty texts have no shingles and are linked with nothing; equal sets
(copies) are linked; a text of fewer words than a shingle is one shingle; a row that repeats
an id is a row of its own; null ids are linked like others, and a component of null ids
only has a null id; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    connected_components, lean, materialize, mix64, one_of_each, pieces, row_key, shingle_hashes, small, string_buffer, text_of, without, word_hashes, word_spans,
)

PARITY = 8  # longs of a parity map
SLICES = 16
SKETCH_BITS = 24  # at most: 64 MB in a counting task, 16 MB broadcast
SKETCH_TASKS = 64, 4096
PARITIES = [f"p{k}" for k in range(PARITY)]
#: Seeds of the two halves of a set's hash.
SET_SEEDS = 0x51ED270B, 0x2545F491


def row_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and rows of a piece, repeats included."""
    starts, ends, rows = word_spans(buf, offsets)
    return shingle_hashes(word_hashes(buf, starts, ends), rows, size, len(offsets) - 1)


def unique(h: np.ndarray, row: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), ordered by row, rank and hash."""
    order = np.lexsort((h, row) if rank is None else (h, rank, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def text_pieces(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = string_buffer(col)
    for i, j in pieces(off):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def _sketch(texts: DataFrame, size: int) -> np.ndarray:
    """Document frequencies of shingles, added up in counters, as eighths of a power of two.

    There is a counter for 4 KB of text, 2**SKETCH_BITS at most. Counting tasks take 256 MB or more
    where they would be many, so what they send stays small beside the input; each slice is
    added up as it comes in.
    """
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(n_bytes >> 12).bit_length(), 12), SKETCH_BITS)
    tasks = min(max(n_bytes >> 28, SKETCH_TASKS[0]), SKETCH_TASKS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for b in batches:
            for _, _, buf, off in text_pieces(b.column(0)):
                h, _ = unique(*row_sets(buf, off, size))
                at, n = np.unique((h & np.uint64((1 << bits) - 1)).astype(np.int64), return_counts=True)
                total[at] += n.astype(np.int32)
        if total.any():
            parts = np.split(total, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts])], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(data.as_buffer(), np.int32)
                sums[k] = sums[k] + own if k in sums else own.astype(np.int64)
        for k, total in sums.items():
            level = np.round(8 * np.log2(1 + total)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()])], ["slice", "counts"])

    kind = "slice int, counts binary"
    parts = texts.select("text").coalesce(tasks).mapInArrow(lean(count), kind).repartitionById(SLICES, "slice").mapInArrow(add, kind).collect()
    out = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for k, data in parts:
        out[k] = np.frombuffer(data, np.uint8)
    return out.ravel()


def set_hash(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the sum of each row's values and of its size."""
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=c[1:])
    return mix64(c[first + n] - c[first] + n.astype(np.uint64))


DESCRIBED = "id long, k long, n int, s long, s2 long, g long, central double, " + "".join(f"{p} long, " for p in PARITIES) + "prefix array<long>"


def least_common(n, num: int, den: int):
    """Shingles that a set of n and any set linked with it have in common, at least."""
    return -(-n * num // den)


def common_prefix(n):
    """c: prefix shingles that a set of n and any linked set of its size or more have in common."""
    return 1 + n // 100


def _needed(a: Column, b: Column) -> Column:
    return (1 + F.floor(F.least(a, b) / 100)).cast("long")


def parities(h: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """(rows, PARITY) longs: each bit is the parity of the row's shingles that fall on it."""
    bit = (mix64(h) & np.uint64(64 * PARITY - 1)).astype(np.int64)
    odd = np.bincount(row * 64 * PARITY + bit, minlength=n_rows * 64 * PARITY).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n_rows, PARITY, 64), axis=2).reshape(n_rows, PARITY, 8).view(np.int64)[:, :, 0]


def _describe(shared, size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        mask = np.uint64(len(sketch) - 1)
        for b in batches:
            for i, j, buf, off in text_pieces(b.column(2)):
                h, row = row_sets(buf, off, size)
                h, row = unique(h, row, sketch[(h & mask).astype(np.int64)])
                n = np.bincount(row, minlength=j - i)
                first = np.cumsum(n) - n
                at = np.arange(len(h)) - first[row]
                # a set so small that only its equals are linked with it has no prefix
                length = np.where(num * (n + 1) <= den * n, n - least_common(n, num, den) + common_prefix(n), 0)
                pre = at < length[row]
                both = [mix64(h ^ np.uint64(k)) for k in SET_SEEDS]
                s, s2 = (set_hash(x, first, n) for x in both)
                g = set_hash(np.where(pre, both[0], np.uint64(0)), first, n)
                central = np.bincount(row, sketch[(h & mask).astype(np.int64)], j - i) / np.maximum(n, 1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(h[pre].view(np.int64)))
                parity = np.concatenate([parities(h[first[x] : first[y - 1] + n[y - 1]], row[first[x] : first[y - 1] + n[y - 1]] - x, y - x) for x, y in steps(j - i)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(x).slice(i, j - i) for x in (0, 1)), pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (s, s2, g)),
                        pa.array(central), *(pa.array(np.ascontiguousarray(parity[:, k])) for k in range(PARITY)), lists,
                    ],
                    [x.split()[0] for x in DESCRIBED.split(", ")],
                )

    return run


def steps(n: int, step: int = 1024) -> Iterator[tuple[int, int]]:
    return ((a, min(a + step, n)) for a in range(0, n, step))


def _fetch(size: int):
    """Shingles of the wanted classes, once for rows of one batch that repeat them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = np.asarray(b.column(1))
            for i, j, buf, off in text_pieces(b.column(0)):
                h, row = unique(*row_sets(buf, off, size))
                n = np.bincount(row, minlength=j - i)
                ends = np.cumsum(n)
                own = set_hash(mix64(h ^ np.uint64(SET_SEEDS[0])), ends - n, n).view(np.int64)
                at = np.flatnonzero(own == wanted[i:j])
                at = at[np.unique(own[at], return_index=True)[1]]
                data = [h[ends[k] - n[k] : ends[k]].tobytes() for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(data, pa.binary())], ["s", "shingles"])

    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets are linked."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(k)] for k in (2, 3)]
            hit = pa.array([linked(x, y, num, den) for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(hit)

    return run


def exact_links(pairs: DataFrame, texts: DataFrame, rows: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes that are linked, as (src, dst); ``rows``: (s, k), the row that a class is read from."""
    return links_among(small(pairs.select("a", "b").distinct()), texts, rows, shingle, num, den)


def links_among(pairs: DataFrame, texts: DataFrame, rows: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """``exact_links`` of distinct pairs that are ``small`` already.

    Texts, and then sets, move by key only if the pairs are more than can be broadcast.
    """
    wanted = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct().join(rows, "s")
    sets = materialize(texts.select("k", "text").join(small(wanted), "k").select("text", "s").mapInArrow(_fetch(shingle), "s long, shingles binary"))
    sides = [sets.select(F.col("s").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab"]
    met = sides[0].join(pairs, "a").join(sides[1], "b")
    return met.select("a", "b", "set_a", "set_b").mapInArrow(_verify(num, den), "src long, dst long").distinct()


def near(a: str, b: str, num: int, den: int) -> Column:
    """Sizes and parities allow a link between the sets of two structs; a null parity allows any."""
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    differ = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITIES), F.lit(0)).cast("long")
    return (m * den >= n * num) & (n * den >= m * num) & F.coalesce(differ * (den + num) <= (den - num) * (n + m), F.lit(True))


def _labelled(docs: DataFrame, shingle: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(id, k, n, linked, component) of each row; linked: other rows are in its component."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).select("id", row_key("id", "text").alias("k"), "text")
    shared = spark.sparkContext.broadcast(_sketch(texts, shingle))
    base = materialize(texts.mapInArrow(lean(_describe(shared, shingle, num, den)), DESCRIBED))

    same = [F.first(c).alias(c) for c in ("n", "g", "central", *PARITIES)]
    classes = base.where("n > 0").groupBy("s", "s2").agg(F.min("id").alias("id"), F.min("k").alias("k"), F.count("*").alias("copies"), *same)
    classes = materialize(classes)
    member = F.struct("s", "n", *PARITIES)
    able = classes.where(F.col("n").cast("long") * den >= (F.col("n").cast("long") + 1) * num)
    groups = able.groupBy("g").agg(F.count("*").alias("sets"), F.max_by("s", "central").alias("first"), F.max("central").alias("central"))
    groups = materialize(groups)
    prefixes = base.where(F.size("prefix") > 0).groupBy("g").agg(F.first("prefix").alias("prefix"))
    tokens = prefixes.select("g", F.explode("prefix").alias("token"))
    several = materialize(tokens.groupBy("token").count().where("count > 1").select("token"))
    tokens = materialize(tokens.join(several, "token"))

    reads = able.select("s", "k")
    # pivots
    pivots = materialize(tokens.join(groups, "g").groupBy("token").agg(F.max_by("first", "central").alias("pivot")))
    met = tokens.join(pivots, "token").groupBy("g", "pivot").agg(F.count("*").alias("common"))
    met = met.unionByName(groups.where("sets > 1").select("g", F.col("first").alias("pivot"), F.lit(2**31).cast("long").alias("common")))
    firsts = groups.select(F.col("first").alias("s")).join(able, "s").select(F.col("s").alias("pivot"), "central", member.alias("y"))
    pairs = met.join(able.select("g", member.alias("x")), "g").join(materialize(firsts), "pivot").where(F.col("x.s") != F.col("pivot"))
    pairs = pairs.where(near("x", "y", num, den) & (2 * F.col("common") >= _needed(F.col("x.n"), F.col("y.n"))))  # a choice of pairs, not a filter of links
    pairs = pairs.groupBy(F.col("x.s").alias("a")).agg(F.max_by("pivot", "central").alias("b"))
    roots = materialize(connected_components(exact_links(pairs, texts, reads, shingle, num, den)))

    # what is left between components
    able = able.join(roots, F.col("s") == F.col("node"), "left").withColumn("label", F.coalesce("root", "s")).drop("node", "root")
    able = materialize(able)
    one = lambda c: F.when(F.count("*") == 1, F.first(c)).alias(c)
    label = F.when(F.min("label") == F.max("label"), F.min("label"))
    whole = able.groupBy("g").agg(F.first("n").alias("n"), *[one(p) for p in PARITIES], label.alias("label"))
    whole = materialize(whole.select("g", F.struct("g", "n", *PARITIES, F.coalesce("label", "g").alias("label")).alias("x"), F.col("label").isNull().alias("mixed")))
    tokens = tokens.join(whole.select("g", F.col("x.label").alias("label")), "g")
    open_ = tokens.groupBy("token", "label").count().groupBy("token").agg(F.max_by("label", "count").alias("main"), F.count("*").alias("labels"))
    open_ = materialize(open_.where("labels > 1").select("token", "main"))
    rows = materialize(tokens.drop("label").join(open_, "token").join(whole.select("g", "x"), "g").select("token", "main", "x"))
    outside = rows.where("x.label <> main")
    apart = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("main")) | (F.col("x.g") < F.col("y.g")))
    pairs = outside.join(rows.select("token", F.col("x").alias("y")), "token").where(apart & near("x", "y", num, den))
    # each shingle orders the pair by its own main component, so shingles in common are counted by unordered pair
    ends = F.least("x.g", "y.g").alias("ga"), F.greatest("x.g", "y.g").alias("gb")
    pairs = pairs.groupBy(*ends).agg(F.count("*").alias("common"), F.first(_needed(F.col("x.n"), F.col("y.n"))).alias("need"))
    pairs = pairs.where("common >= need").select("ga", "gb").unionByName(whole.where("mixed").select(F.col("g").alias("ga"), F.col("g").alias("gb")))
    sides = [able.select(F.col("g").alias(f"g{k}"), F.struct("s", "n", "label", *PARITIES).alias(f"x{k}")) for k in "ab"]
    pairs = pairs.join(sides[0], "ga").join(sides[1], "gb").where((F.col("xa.label") != F.col("xb.label")) & ((F.col("ga") != F.col("gb")) | (F.col("xa.s") < F.col("xb.s"))))
    pairs = pairs.where(near("xa", "xb", num, den)).select(F.col("xa.s").alias("a"), F.col("xb.s").alias("b"))
    label_of = able.select("s", "label")
    more = exact_links(pairs, texts, reads, shingle, num, den).join(label_of.withColumnsRenamed({"s": "src", "label": "u"}), "src").join(label_of.withColumnsRenamed({"s": "dst", "label": "v"}), "dst")
    last = connected_components(more.select(F.col("u").alias("src"), F.col("v").alias("dst")))

    label = able.select("s", "s2", "label").join(last, F.col("label") == F.col("node"), "left").select("s", "s2", F.coalesce("root", "label").alias("label"))
    known = materialize(classes.select("s", "s2", "id", "copies").join(label, ["s", "s2"], "left").withColumn("label", F.coalesce("label", "s")))
    best = known.groupBy("label").agg(F.min("id").alias("component"), F.sum("copies").alias("all")).where("all > 1")
    known = known.join(materialize(best), "label").select("s", "s2", "label", "component")
    out = base.select("id", "k", "n", "s", "s2").join(known, ["s", "s2"], "left")
    component = F.when(F.col("label").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select("id", "k", "n", "label", component.alias("component"))


def components(
    docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; linked at den * intersection >= num * union."""
    rows = _labelled(docs, shingle, num, den, id_col, text_col)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(
    docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest id, null last.

    Rows without links stay, also where ids are null or repeated.
    """
    return one_row_each(docs, _labelled(docs, shingle, num, den, id_col, text_col), id_col, text_col)


def one_row_each(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each label of ``labelled`` (id, k, label); rows without a label stay."""
    rows = materialize(labelled.where("label is not null").select("id", "k", "label"))
    own = F.struct(F.col("id").isNull(), "id", "k")
    best = materialize(rows.groupBy("label").agg(F.min(own).alias("best")))
    rows = rows.join(best, "label").withColumn("stays", own.eqNullSafe(F.col("best")))
    twins = rows.where("stays").groupBy("id", "k").count().where("count > 1").select("id", "k")
    out = without(docs, rows.where("not stays").select("id", "k"), id_col, text_col)
    return one_of_each(out, twins, id_col, text_col)
