"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A text is its set of word shingles; equal sets are one *class*. One hash deals a set's shingles to
BANDS * ROWS bins and orders them inside each; an empty bin takes the value of the first filled bin
on a seeded walk of its own (optimal densification), so two sets fill their empty bins alike.
ROWS neighbouring bins are a band; equal bands are a bucket.

Candidates are stars: a bucket's members are compared with its centre, the member that meets most others,
so a bucket of m members costs m edges, not m * m. All links are confirmed on the full sets.

1. Each class is verified against the most popular of its centres: one edge a class.
2. Star edges between different components are verified.
3. What stars can't decide (members of one bucket that still are in different components, the centre
   being near neither) is compared pair by pair: members outside the bucket's largest component with
   those of other components, sieved losslessly by sizes and 512-bit parity maps. A bucket in one
   component, however large, costs nothing here. So stars lose no pair that shares a bucket.

Two sets of similarity s share no bucket with probability (1 - s**ROWS)**BANDS: 6e-9 at 0.85, less above.
Bounded by the number of classes and bands but for step 3, where a bucket of sets that are alike,
but not linked, has its pairs looked at one by one, and only pairs that pass the sieve are emitted.

Defined cases: null and empty texts have no shingles and are linked with nothing; equal sets are linked;
a text of fewer words than a shingle is one shingle; rows that repeat an id are rows of their own; null ids
are linked like others, and a component of null ids only has a null id, all its rows being kept by
``components``; extra columns are dropped by ``components`` and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, mix64, release, row_key, small, text_of
from .jaccard_join import PARITIES, PARITY, SET_SEEDS, links_among, near, one_row_each, parities, row_sets, set_hash, steps, text_pieces, unique

#: Bins of a band, and bands.
ROWS, BANDS = 6, 40
BINS = ROWS * BANDS


def walks(bins: int = BINS) -> np.ndarray:
    """(bins, bins): the order in which each bin looks for a filled one, itself first."""
    at = np.arange(bins, dtype=np.uint64)
    draw = mix64(mix64(at[:, None] + np.uint64(1)) ^ (at[None, :] * np.uint64(0x9E3779B97F4A7C15)))
    np.fill_diagonal(draw, 0)
    return np.argsort(draw, axis=1, kind="stable")


_WALKS = walks()


def signatures(h: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, BINS) densified minima; ``h`` is sorted in each row, and a row without hashes is all zero."""
    spread = mix64(h ^ np.uint64(0x6A09E667F3BCC909))
    bin_ = ((spread >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    cell = row * BINS + bin_
    order = np.lexsort((spread, cell))
    cell, spread = cell[order], spread[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out, filled = np.zeros(n_rows * BINS, np.uint64), np.zeros(n_rows * BINS, bool)
    out[cell[first]], filled[cell[first]] = spread[first], True
    own = filled.reshape(n_rows, BINS).any(axis=1)
    base = np.repeat(np.arange(n_rows) * BINS, BINS)
    empty = np.flatnonzero(~filled & np.repeat(own, BINS))
    for k in range(1, BINS):
        if not len(empty):
            break
        source = base[empty] + _WALKS[empty % BINS, k]
        hit = filled[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    return out.reshape(n_rows, BINS)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys of the bands."""
    parts = minima.reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key


DESCRIBED = "id long, k long, n int, s long, s2 long, " + "".join(f"{p} long, " for p in PARITIES) + "bands array<long>"


def _describe(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in text_pieces(b.column(2)):
                h, row = unique(*row_sets(buf, off, size))
                counts = np.bincount(row, minlength=j - i)
                ends = np.cumsum(counts)
                for x, y in steps(j - i):
                    n = counts[x:y]
                    first = ends[x:y] - n
                    part = slice(int(first[0]), int(ends[y - 1]))
                    own, at, first = h[part], row[part] - x, first - first[0]
                    s, s2 = (set_hash(mix64(own ^ np.uint64(seed)), first, n) for seed in SET_SEEDS)
                    able = num * (n + 1) <= den * n  # smaller sets are linked with their equals only
                    keys = band_keys(signatures(own, at, y - x))[able]
                    cuts = np.concatenate(([0], np.cumsum(able * BANDS))).astype(np.int32)
                    bits = parities(own, at, y - x)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(b.column(c).slice(i + x, y - x) for c in (0, 1)), pa.array(n.astype(np.int32)), pa.array(s.view(np.int64)), pa.array(s2.view(np.int64)),
                            *(pa.array(np.ascontiguousarray(bits[:, p])) for p in range(PARITY)),
                            pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.ascontiguousarray(keys).view(np.int64).ravel())),
                        ],
                        [c.split()[0] for c in DESCRIBED.split(", ")],
                    )

    return run


def _labelled(docs: DataFrame, shingle: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(id, k, n, label, component) of each row; a label where other rows are in its component, else null."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).select("id", row_key("id", "text").alias("k"), "text")
    base = materialize(texts.mapInArrow(_describe(shingle, num, den), DESCRIBED))
    same = [F.first(c).alias(c) for c in ("n", *PARITIES, "bands")]
    classes = base.where("n > 0").groupBy("s", "s2").agg(F.min("id").alias("id"), F.min("k").alias("k"), F.count("*").alias("copies"), *same)
    classes = materialize(classes)

    rows = classes.where(F.size("bands") > 0).select("s", F.explode("bands").alias("band"))
    several = materialize(rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"))
    rows = materialize(rows.join(several, "band"))
    popular = rows.groupBy("s").agg(F.sum("members").alias("met"))
    able = materialize(classes.join(popular, "s").select("s", "k", "met", F.struct("s", "n", *PARITIES).alias("x")))
    reads = able.select("s", "k")
    centres = rows.join(able.select("s", "met"), "s").groupBy("band").agg(F.max_by("s", F.struct("met", "s")).alias("centre"))
    stars = rows.join(materialize(centres), "band").where("s <> centre").select("s", "centre").distinct()
    middle = able.select(F.col("s").alias("centre"), F.col("met").alias("centre_met"), F.col("x").alias("y"))
    stars = stars.join(able.select("s", "x"), "s").join(materialize(middle), "centre").where(near("x", "y", num, den))
    stars = materialize(stars.select("s", "centre", "centre_met"))

    def settle(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """(s, label) after the links among ``pairs`` (a, b) of classes are added."""
        pairs = small(pairs.distinct())
        if pairs.isEmpty():
            return labels
        found = links_among(pairs, texts, reads, shingle, num, den)
        u, v = (labels.select(F.col("s").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst"))
        met = found.join(u, "src").join(v, "dst").select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst"))
        roots = connected_components(met)
        out = labels.join(roots, F.col("label") == F.col("node"), "left").select("s", F.coalesce("root", "label").alias("label"))
        out = materialize(out)
        release(docs.sparkSession)
        return out

    labels = able.select("s", F.col("s").alias("label"))
    one = stars.groupBy(F.col("s").alias("a")).agg(F.max_by("centre", F.struct("centre_met", "centre")).alias("b"))
    labels = settle(one, labels)

    ends = [labels.select(F.col("s").alias(c), F.col("label").alias(f"{c}_label")) for c in ("s", "centre")]
    apart = stars.join(ends[0], "s").join(ends[1], "centre").where("s_label <> centre_label")
    labels = settle(apart.select(F.col("s").alias("a"), F.col("centre").alias("b")), labels)

    # what no star has decided: buckets that still hold several components
    held = materialize(rows.select("band", "s").join(labels, "s"))
    open_ = held.groupBy("band", "label").count().groupBy("band").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"))
    open_ = materialize(open_.where("labels > 1").select("band", "main"))
    left = materialize(held.join(open_, "band").join(able.select("s", "x"), "s").select("band", "main", "label", "x"))
    other = left.select("band", F.col("label").alias("other"), F.col("x").alias("y"))
    cross = (F.col("label") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("x.s") < F.col("y.s")))
    pairs = left.where("label <> main").join(other, "band").where(cross & near("x", "y", num, den))
    pairs = pairs.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b"))
    labels = settle(pairs, labels)

    known = materialize(classes.select("s", "s2", "id", "copies").join(labels, "s", "left").withColumn("label", F.coalesce("label", "s")))
    best = known.groupBy("label").agg(F.min("id").alias("component"), F.sum("copies").alias("all")).where("all > 1")
    known = known.join(materialize(best), "label").select("s", "s2", "label", "component")
    out = base.select("id", "k", "n", "s", "s2").join(known, ["s", "s2"], "left")
    component = F.when(F.col("label").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select("id", "k", "n", "label", component.alias("component"))


def components(
    docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; linked at den * intersection >= num * union."""
    rows = _labelled(docs, shingle, num, den, id_col, text_col)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def keep_one(
    docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest id, null last."""
    return one_row_each(docs, _labelled(docs, shingle, num, den, id_col, text_col), id_col, text_col)
