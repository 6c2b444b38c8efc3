"""A registry that is kept up to date by what changed: each file's contributions are taken back and put in anew.

Three bucketed tables: ``contributions``, one row per (category, name, file), and ``registry``, its entries, both by a hash of
(category, name); tables by file (``cache`` and others) by a hash of the path. An edit of a few files names a few buckets: only
these are read and written, and first places and locations are computed again only for names of which a
contribution has changed. Names that a file keeps as they were are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.operators import registry
from symbolith.session import materialize
from symbolith.sources import tables

BUCKETS = 64
KEY = ["category", "name"]
ROW = [*KEY, "file", "usages", "first"]


def contributions(defs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What each file adds to each name, with the name's bucket."""
    return registry.per_file(defs).select(*ROW, tables.bucket_of(buckets, *KEY).alias("bucket"))


def build(defs: DataFrame, home: str, buckets: int = BUCKETS) -> None:
    """Write both tables from all definitions."""
    own = materialize(contributions(defs, buckets))
    tables.write(own, f"{home}/contributions", "bucket")
    tables.write(with_bucket(registry.of_contributions(own), buckets), f"{home}/registry", "bucket")


def with_bucket(rows: DataFrame, buckets: int = BUCKETS, *keys: str) -> DataFrame:
    return rows.withColumn("bucket", tables.bucket_of(buckets, *(keys or KEY)))


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, name, bucket) of the names of which a contribution is gone, new or another."""
    ours, theirs = before.select(*ROW, "bucket"), after.select(*ROW, "bucket")
    changed = ours.exceptAll(theirs).unionByName(theirs.exceptAll(ours))
    return changed.select(*KEY, "bucket").distinct()


def update(spark: SparkSession, home: str, files: DataFrame, before: DataFrame, after: DataFrame, buckets: int = BUCKETS) -> int:
    """Bring both tables from ``before`` to ``after``, the definitions that ``files`` (file) had and have; the names touched."""
    after = materialize(contributions(after, buckets))
    names = materialize(touched(contributions(before, buckets), after))
    some = [r["bucket"] for r in names.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not some:
        return 0
    held = tables.read_buckets(spark, f"{home}/contributions", some).join(files, "file", "left_anti")
    own = materialize(held.unionByName(after.where(F.col("bucket").isin(some))))
    entries = with_bucket(registry.of_contributions(own.join(names, [*KEY, "bucket"], "left_semi")), buckets)
    others = tables.read_buckets(spark, f"{home}/registry", some).join(names, [*KEY, "bucket"], "left_anti")
    entries = materialize(others.unionByName(entries))
    tables.replace_buckets(own, f"{home}/contributions", some)
    tables.replace_buckets(entries, f"{home}/registry", some)
    return names.count()


def by_file(spark: SparkSession, path: str, files: DataFrame, rows: DataFrame, key: str = "file", buckets: int = BUCKETS) -> None:
    """Replace the rows of ``files`` (file) in a table by file; a table that isn't there is written."""
    rows = with_bucket(rows, buckets, key)
    state, _ = tables.read(spark, path)
    if state != "ok":
        tables.write(rows, path, "bucket")
        return
    places = files.select(F.col("file").alias(key))
    some = [r["bucket"] for r in with_bucket(places, buckets, key).select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if some:
        held = tables.read_buckets(spark, path, some).join(places, key, "left_anti")
        tables.replace_buckets(materialize(held.unionByName(rows)), path, some)
