"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups.

DataFrame functions only.

1. 16-byte hashes are counted, with a combine before the shuffle. A hash that stands once is
   a text of its own and needs no comparison.
2. Texts of the other hashes only are grouped by (hash, text): the key comparison of the
   aggregate is the byte comparison, so texts that merely collide stay apart. The map side
   combines first: a group of copies sends one row per map task, however large it is.
   Hashes of a counted number, at most ``common.BROADCAST_ROWS``, are broadcast to pick these texts
   before the shuffle; more are joined by key.
3. Classes of two or more are joined back, on (hash, sha256), to narrow rows without text. Small
   aggregates are materialised first, so adaptive execution can split a hot class.

Defined cases: a null text counts as the empty text; all empty texts are one class. A
row that repeats both id and text gets the verdict of its twin in ``annotate``;
``drop_duplicates`` leaves one row per text all the same. A null id never is the
representative unless all ids of its class are null. Other columns pass through
``annotate`` untouched; its result columns replace columns of the same names. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, small, text_of

VERDICT = ("keep_id", "group_size", "kept", "text_sha256")


def content_hash(text: Column) -> Column:
    """128 bits of the content, as 16 bytes."""
    return F.unhex(F.md5(text))


def classes(df: DataFrame, text_col: str, id_col: str, keep: str) -> DataFrame:
    """One row per text that several rows have: hash, sha256, size and the id that stays."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", content_hash(F.col("_text")))
    several = rows.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    groups = rows.join(small(several), "_h").groupBy("_h", "_text").agg(F.count("*").alias("_n"), best("_id").alias("_keep"))
    return groups.where("_n > 1").select("_h", F.sha2("_text", 256).alias("_sha"), "_n", "_keep")


def _judged(df: DataFrame, many: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """``df`` with hash, sha256 and, where several rows have its text, size and id that stays."""
    text = text_of(text_col)
    names = fresh(df, "_h", "_sha", "_n", "_keep")
    rows = df.withColumns({names[0]: content_hash(text), names[1]: F.sha2(text, 256)})
    return rows.join(many.withColumnsRenamed(dict(zip(("_h", "_sha", "_n", "_keep"), names))), names[:2], "left"), names


def annotate(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """Each row of ``df`` with keep_id, group_size, kept and text_sha256."""
    many = small(classes(df, text_col, id_col, keep))
    out, (h, sha, n, best) = _judged(df.drop(*[c for c in VERDICT if c not in (text_col, id_col)]), many, text_col)
    out = out.withColumns(
        {
            "keep_id": F.when(F.col(n).isNull(), F.col(id_col)).otherwise(F.col(best)),
            "group_size": F.coalesce(n, F.lit(1).cast("long")),
            "text_sha256": F.col(sha),
        }
    )
    return out.withColumn("kept", F.col("keep_id").eqNullSafe(F.col(id_col))).drop(h, sha, n, best)


def drop_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row of ``df`` per text, with the columns of ``df``: that with the smallest (or largest) id.

    Where several rows have that id too, their other columns decide; rows alike in all columns
    are interchangeable.
    """
    many = materialize(classes(df, text_col, id_col, keep))
    narrow, (h, sha, n, best) = _judged(df.select(id_col, text_col), many, text_col)
    twins = narrow.where(F.col(best).eqNullSafe(F.col(id_col)) & F.col(n).isNotNull()).groupBy(h, sha).count().where("count > 1")
    many = many.join(materialize(twins.select(F.col(h).alias("_h"), F.col(sha).alias("_sha"), F.lit(True).alias("_twins"))), ["_h", "_sha"], "left")
    many = many.withColumn("_n", F.coalesce("_twins", F.lit(False))).drop("_twins")
    out, (h, sha, several, best) = _judged(df, small(many), text_col)
    leads = F.col(best).eqNullSafe(F.col(id_col))
    plain = out.where(F.col(several).isNull() | (leads & ~F.col(several))).select(*[F.col(f"`{c}`") for c in df.columns])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = out.where(leads & F.col(several)).groupBy(h, sha).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_one")).select("_one.*")
    return plain.unionByName(one)
