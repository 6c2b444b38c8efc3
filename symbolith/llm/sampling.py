"""Bounded samples of labelled rows. Their bounds are parameters: rows of a class, and bytes of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on, at most.
TRAIN_ROWS_PER_CLASS = 1500
#: Labelled texts of more bytes are not fitted on (all texts are scored whole).
TRAIN_TEXT_BYTES = 100_000


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held_out: int,
    per_class: int = TRAIN_ROWS_PER_CLASS,
    text_bytes: int = TRAIN_TEXT_BYTES,
    seed: int = 11,
) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` rows a class, never of the held-out fold.

    Ids are drawn from the narrow labels table by seeded hash first, then their texts are
    fetched: texts of other rows don't move. Drawn texts of more than ``text_bytes`` are skipped.
    Conflicting labels of one id are left out, as are null ids and null labels; of rows that
    repeat an id the least text counts. The bounds hold however large the corpus grows.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.where(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_top"))
    rows = rows.where("y = _top").drop("_top").withColumn("_u", F.xxhash64(F.lit(seed), "doc_id"))
    drawn = [rows.where(F.col("y") == y).orderBy("_u", "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * per_class narrow rows
    got = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= text_bytes).join(ids, "doc_id")
    got = got.groupBy("doc_id", "_u").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return [(r["text"], int(r["y"])) for r in got.orderBy("_u", "doc_id").toLocalIterator()]


def balance(y: list[int] | tuple[int, ...]) -> list[float]:
    """Weights that give both classes half of the whole, whatever the sample's shares.

    The bound on rows of a class makes those shares depend on the corpus's size; scores don't.
    """
    n, ones = len(y), sum(y)
    return [n / (2 * ones) if v else n / (2 * (n - ones)) for v in y]
