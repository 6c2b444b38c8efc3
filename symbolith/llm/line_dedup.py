"""Line dedup across documents by a deletion-neighbourhood join. DataFrame functions only.

Lines are compared over all documents. An occurrence is removed if the same line, or one
within edit distance ``bound`` of it, stands earlier, by (id, text hash, line number); so the
earliest of its kind stays. Blank lines are never removed. Lines shorter than ``near_from``
characters are compared exactly: there, one character is no near copy (``- a``, ``- b``).

1. Occurrences are grouped by a 128-bit hash: one row per distinct line and map task.
2. *Sieve.* One edit leaves the first or the second half of a line as it was. Keys of both
   halves, aligned by the shorter length of a possible pair, are counted; only lines with a
   key that another distinct line has go on.
3. *Narrow.* Of those, about sqrt(length) segments are left out in turn. A key with one
   segment missing that another line shares says where the edit is.
4. *Join.* Inside such a segment all variants with a character deleted, and the line itself
   for a partner that is longer by one, are emitted as hashed keys. Equal keys are joined. A key's
   group is bounded by its length and the alphabet, however hot a template is. Pairs are
   verified by edit distance.

Steps 3 and 4 are lossless: two lines within one edit share a segment key and a variant.
Counts are pre-aggregated; rows are joined with counts by plain exchanges that adaptive
execution can split.

Defined cases: null and empty texts have one blank line; null ids come first; rows that share
id and text are twins, equally early, and both stay; rows that share an id only, or have none,
are told apart by their texts, whose hash orders them; extra columns pass through ``clean`` and
are dropped by ``removed_lines``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, row_key, text_of

NEAR_FROM = 16


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, line_no, line) of lines that aren't blank, numbered from 0; (id, k) is the row."""
    split = F.split(text_of(text_col), "\n", -1)
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("k"), F.posexplode(split).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"\S"))


def _left(x: Column, n: Column) -> Column:
    return F.substring(x, F.lit(1), n)


def _right(x: Column, n: Column) -> Column:
    return F.substring(x, F.char_length(x) - n + 1, n)


def _half_keys(line: Column, m: Column) -> list[Column]:
    """Keys of the halves of a line in a pair whose shorter line has m characters."""
    p = F.floor(m / 2).cast("int")
    return [F.xxhash64(F.lit(0), m, _left(line, p)), F.xxhash64(F.lit(1), m, _right(line, m - p))]


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key several rows have; rows have no repeated (key, line)."""
    several = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return rows.join(materialize(several), key)


def _near(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, near_from: int) -> DataFrame:
    """Hashes of lines with an earlier line one edit away."""
    long = firsts.where(F.col("chars") >= near_from)
    keys = long.select("h", F.explode(F.array_distinct(F.array("a0", "a1", "b0", "b1"))).alias("key"))
    some = _shared(keys, "key").select("h").distinct()
    survivors = long.join(some, "h").select("h", "first")
    wanted = survivors.groupBy(F.col("first.k").alias("k")).agg(F.collect_list(F.struct("first.line_no", "h", "first")).alias("wanted"))
    texts = docs.select(row_key(id_col, text_col).alias("k"), text_of(text_col).alias("text"))
    found = texts.join(wanted, "k").select(F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("w"))
    found = found.select("w.h", "w.first", F.get("lines", F.col("w.line_no")).alias("line"))
    found = found.where(F.unhex(F.md5("line")) == F.col("h"))  # not a line of a row whose hash is the same
    found = materialize(found.groupBy("h").agg(F.first("first").alias("first"), F.first("line").alias("line")))

    length = F.char_length("line")
    roles = found.select("h", "line", F.explode(F.array(length, length - 1)).alias("m"))
    roles = roles.withColumn("w", F.ceil(F.sqrt(F.col("m"))).cast("int"))
    roles = roles.withColumn("s", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / F.col("w")).cast("int") - 1)))
    end = F.least((F.col("s") + 1) * F.col("w"), F.col("m"))
    left, right = _left(F.col("line"), F.col("s") * F.col("w")), _right(F.col("line"), F.col("m") - end)
    cut = roles.select("h", "m", "w", "s", F.xxhash64(F.lit(2), "m", "s", left, right).alias("key"))
    places = _shared(cut, "key").select("h", "m", "w", "s").distinct()

    rows = places.join(found, "h").withColumn("end", end)
    last = F.when(length == F.col("m"), F.col("end") - 1).otherwise(F.col("end"))
    deleted = F.transform(
        F.sequence(F.col("s") * F.col("w"), last),
        lambda j: F.xxhash64(F.concat(_left(F.col("line"), j), _right(F.col("line"), length - j - 1))),
    )
    own = F.when(length == F.col("m"), F.array(F.xxhash64("line"))).otherwise(F.array().cast("array<bigint>"))
    variants = rows.select("h", "first", F.explode(F.array_distinct(F.concat(own, deleted))).alias("v")).distinct()
    variants = materialize(_shared(variants, "v"))
    earlier = variants.select("v", F.col("h").alias("h0"), F.col("first").alias("first0"))
    pairs = variants.join(earlier, "v").where("first0 < first").select("h", "h0").distinct()
    text = found.select("h", "line")
    pairs = pairs.join(text, "h").join(text.withColumnsRenamed({"h": "h0", "line": "line0"}), "h0")
    return pairs.where(F.levenshtein("line", "line0", 1) >= 0).select("h").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, line_no) of each occurrence that goes; options: bound, near_from."""
    return _removed(docs, id_col, text_col, **options).select("id", "line_no")


def _removed(docs: DataFrame, id_col: str, text_col: str, bound: int = 1, near_from: int = NEAR_FROM) -> DataFrame:
    """(id, k, line_no) of each occurrence that goes."""
    if bound not in (0, 1):
        raise ValueError("bound is 0 or 1")
    lines = lines_of(docs, id_col, text_col).withColumns({"h": F.unhex(F.md5("line")), "chars": F.char_length("line")})
    line, chars = F.col("line"), F.col("chars")
    keys = dict(zip(("a0", "a1", "b0", "b1"), [*_half_keys(line, chars), *_half_keys(line, chars - 1)]))
    near_only = lambda k: F.when(chars >= near_from, k)
    rows = lines.select("id", "k", "line_no", "h", "chars", *[near_only(k).alias(n) for n, k in keys.items()])
    aggs = [F.min(F.struct("id", "k", "line_no")).alias("first"), F.count("*").alias("n"), F.max("chars").alias("chars")]
    firsts = materialize(rows.groupBy("h").agg(*aggs, *[F.max(k).alias(k) for k in keys]))
    flags = firsts.where("n > 1").select("h", "first", F.lit(False).alias("near"))
    if bound:
        near = _near(docs, firsts, id_col, text_col, near_from)
        flags = flags.unionByName(near.select("h", F.lit(None).cast(flags.schema["first"].dataType).alias("first"), F.lit(True).alias("near")))
        flags = flags.groupBy("h").agg(F.max("first").alias("first"), F.max("near").alias("near"))
    flags = materialize(flags)
    gone = lines.select("id", "k", "line_no", "h").join(flags, "h")
    own = F.struct("id", "k", "line_no")
    return gone.where(F.col("near") | (F.col("first").isNotNull() & ~own.eqNullSafe(F.col("first")))).select("id", "k", "line_no")


def _gone(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(id, k, _gone) of each row: the numbers of its removed lines, no more than it has."""
    rows = _removed(docs, id_col, text_col, **options).distinct()
    return rows.groupBy("id", "k").agg(F.sort_array(F.collect_list("line_no")).alias("_gone"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Each row's id, n_lines, n_removed and the numbers of the removed lines."""
    gone = _gone(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("_own"), row_key(id_col, text_col).alias("_key"), F.size(F.split(text_of(text_col), "\n", -1)).cast("long").alias("n_lines"))
    out = rows.join(gone, (F.col("_key") == F.col("k")) & F.col("_own").eqNullSafe(F.col("id")), "left")
    gone_or_none = F.coalesce("_gone", F.array().cast("array<int>"))
    return out.select(F.col("_own").alias(id_col), "n_lines", F.size(gone_or_none).cast("long").alias("n_removed"), gone_or_none.alias("removed_lines"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without the removed lines; a null text stays null."""
    own, key, lines = fresh(docs, "_own", "_key", "_gone")
    gone = _gone(docs, id_col, text_col, **options).withColumnsRenamed({"id": own, "k": key, "_gone": lines})
    out = docs.join(gone, (row_key(id_col, text_col) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(own)), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(lines, i))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.withColumn(text_col, text).drop(own, key, lines)
