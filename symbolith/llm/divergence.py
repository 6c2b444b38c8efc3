"""Source divergence audit: how the terms of each source differ from those of its peers in a language.

Each (lang, source) group is a vector over its language's kept terms; p is a smoothed share in billionths, and
two vectors differ in a term by (p - q)**2 / (p + q), floored. All arithmetic is on whole numbers.

1. **Count.** Terms are counted by group in Arrow batches, with the documents that hold them; a task sends each
   distinct (group, term) once.
2. **Slices.** A language's kept terms are dealt by hash to slices of some SLICE_TERMS terms, and numbered in
   order inside. A group's slice is a dense vector of bounded size, kept as compressed counts.
3. **Systolic rotation.** The groups of a language are seated, about sqrt(groups) to a seat. (lang, slice, seat) is the
   resident of a task. In round-robin tournament order (the circle method) each seat meets each other seat in
   one round, and itself in a last one: the compressed vectors of the travelling seat pass by one at a time, in order of
   rounds, and each is compared with all residents. The measure is the same both ways, so a meeting gives
   both directions. Which of two seats travels alternates, so all seats work alike.
4. **Rank.** Each resident keeps a heap of its ``top`` terms of a slice against the whole language; the heaps' terms,
   and the sums over slices, are ranked at the end.

Nothing is held whole: a task holds a seat's slices. What moves is, for each round, half of the compressed vectors.

Defined cases: null text, lang or source is ''; a group without terms, or a language without kept terms, gives
each kept term the count 0; a language with no kept terms has the value 0 for all pairs; a single source has no
pairs; repeated rows and ids count each time; ties are ranked by the item's UTF-8 bytes; extra columns are dropped;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Distinct terms, over all groups, that a counting task holds at a time.
HELD_TERMS = 300_000
#: Terms of a slice, about.
SLICE_TERMS = 8192

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = re.compile(TERM).findall
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            # a group without terms is a row without a term
            cols = [[lang] * (len(n) + 1), [source] * (len(n) + 1), [None, *n], [0, *n.values()], [0, *(docs[t] for t in n)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for b in batches:
        for text, lang, source in zip(*(b.column(k) for k in range(3))):
            own = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            found = terms(text.as_py().encode().translate(_LOWER).decode())
            own[0].update(found)
            own[1].update(set(found))
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from out()
            held.clear()
    yield from out()


def share(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in steps of a thousand that stay in 63 bits."""
    whole = total + 2 * terms
    out, rest = np.divmod(n.astype(np.int64) + 2, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pack(n: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(n, np.int64).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


RESIDENT = "lang string, slice int, no int, total long, terms long, vector binary, tid int, value long"


def _reside(top: int):
    """Compressed vectors of groups in a slice, and the terms of their local heaps.

    Rows come by (lang, slice, no): the language's own counts have the number -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        place, q = None, np.zeros(0, np.int64)
        for b in batches:
            rows = []
            for lang, slice_, no, total, terms, cells in zip(*b.columns):
                head = (lang.as_py(), slice_.as_py(), no.as_py(), total.as_py(), terms.as_py())
                own = cells.values if cells.is_valid else None
                if head[2] < 0:
                    place = head[:2]
                    q = share(dense(own, len(own)), head[3], head[4])
                    continue
                if head[:2] != place:
                    continue  # no kept term fell into this slice
                n = dense(own, len(q))
                rows.append((*head, pack(n), None, None))
                p = share(n, head[3], head[4])
                more = np.flatnonzero((n > 0) & (p > q))
                f = divergence(p[more], q[more])
                best = heapq.nsmallest(top, zip((-f).tolist(), more.tolist()))
                rows.extend((*head, None, at + 1, -v) for v, at in best)
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [x.split()[0] for x in RESIDENT.split(", ")])

    return run


def dense(cells: pa.StructArray | None, size: int) -> np.ndarray:
    """Counts by term number, from (tid, n) cells."""
    out = np.zeros(size, np.int64)
    if cells is not None:
        out[cells.field("tid").to_numpy() - 1] = cells.field("n").to_numpy()
    return out


def meetings(seats: int) -> list[tuple[int, int, int]]:
    """(round, home, travelling) of each pair of seats, by the circle method; each seat meets itself last."""
    n = seats + seats % 2  # an odd seat out rests
    out = []
    for a in range(seats):
        for b in range(a + 1, seats):
            round_ = (2 * a if b == n - 1 else a + b) % (n - 1)
            out.append((round_, a, b) if (b - a) % 2 else (round_, b, a))
    return sorted(out) + [(n, a, a) for a in range(seats)]


MET = "lang string, a int, b int, value long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (lang, slice, seat, round): residents have round -1, then peers pass by."""
    place, resident, sums = None, [], {}

    def out() -> pa.RecordBatch:
        rows = [(*k, v) for k, v in sums.items()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], [x.split()[0] for x in MET.split(", ")])

    for b in batches:
        for lang, slice_, seat, round_, own, no, total, terms, vector in zip(*(c.to_pylist() for c in b.columns)):
            if (lang, slice_, seat) != place:
                place, resident = (lang, slice_, seat), []
                if len(sums) > HELD_TERMS:
                    yield out()
                    sums.clear()
            p = share(unpack(vector), total, terms)
            if round_ < 0:
                resident.append((no, p))
                continue
            for other, q in resident:
                if own and other >= no:
                    continue  # a seat that meets itself: each pair once
                key = (lang, min(no, other), max(no, other))
                sums[key] = sums.get(key, 0) + int(divergence(p, q).sum())
    yield out()



def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, slice_terms: int = SLICE_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, all peers; part ``term``, the ``top`` terms of a group."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counts = clean.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = materialize(counts)
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = materialize(kept.select("lang", "term", "lang_n"))
    langs = materialize(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")))
    slices = max(1, -(-(langs.agg(F.max("terms")).first()[0] or 0) // slice_terms))
    kept = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int"))
    kept = materialize(kept.withColumn("tid", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term"))))

    cells = counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    cells = materialize(cells.select("lang", "source", "slice", "tid", "n"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = materialize(groups.withColumn("groups", F.count("*").over(Window.partitionBy("lang"))))

    # residents: each group has a vector in each slice of its language, all zero where it has none of its terms
    cell = F.collect_list(F.struct("tid", "n")).alias("cells")
    whole = kept.withColumnRenamed("lang_n", "n").groupBy("lang", "slice").agg(cell).join(small(langs), "lang")
    whole = whole.select("lang", "slice", F.lit(-1).alias("no"), F.col("lang_total").alias("total"), "terms", "cells")
    own = cells.groupBy("lang", "source", "slice").agg(cell)
    places = groups.where("terms > 0").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    places = places.join(own, ["lang", "source", "slice"], "left").select("lang", "slice", "no", "total", "terms", "cells").unionByName(whole)
    places = places.repartition(parts, "lang", "slice").sortWithinPartitions("lang", "slice", "no")
    resident = materialize(places.mapInArrow(_reside(top), RESIDENT))

    sizes = sorted(r[0] for r in groups.select("groups").distinct().toLocalIterator())  # one row a distinct number of sources
    seating = [(g, r, h, t) for g in sizes for r, h, t in meetings(_seats(g))]
    schedule = small(spark.createDataFrame(seating, "groups long, round int, home int, travels int"))
    seat_of = groups.select("lang", "no", F.col("groups"), F.floor(F.col("no") / F.ceil(F.sqrt("groups"))).cast("int").alias("seat"))
    vectors = resident.where("vector is not null").select("lang", "slice", "no", "total", "terms", "vector").join(small(seat_of), ["lang", "no"])
    head = ["no", "total", "terms", "vector"]
    stay = vectors.select("lang", "slice", "seat", F.lit(-1).alias("round"), F.lit(False).alias("own"), *head)
    pass_ = vectors.join(schedule, (vectors["groups"] == schedule["groups"]) & (F.col("seat") == F.col("travels")))
    pass_ = pass_.select("lang", "slice", F.col("home").alias("seat"), "round", (F.col("home") == F.col("travels")).alias("own"), *head)
    met = stay.unionByName(pass_).repartition(parts, "lang", "slice", "seat").sortWithinPartitions("lang", "slice", "seat", "round", "no")
    met = met.mapInArrow(_meet, MET).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = met.select("lang", F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("peer")), F.struct(F.col("b").alias("no"), F.col("a").alias("peer")))).alias("d"), "value")
    name = groups.select("lang", "no", "source")
    pairs = both.select("lang", "d.no", "d.peer", "value").join(name, ["lang", "no"]).join(name.select("lang", F.col("no").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])
    bare = groups.where("terms = 0 and groups > 1").select("lang", "source")  # no vector to meet
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", "item", "value").unionByName(bare.select("lang", "source", "item", "value"))

    terms = resident.where("tid is not null").select("lang", "slice", "no", "tid", "value")
    terms = terms.join(kept.select("lang", "slice", "tid", F.col("term").alias("item")), ["lang", "slice", "tid"]).join(name, ["lang", "no"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")) for part, x in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def _seats(groups: int) -> int:
    """Seats of a language with so many groups, about sqrt(groups) groups on each."""
    a_seat = int(np.ceil(np.sqrt(groups)))
    return -(-groups // a_seat)
