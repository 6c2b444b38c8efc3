"""The symbol registry: definitions counted, first and alternate places, lookups.

Definitions are rows (category, name, file, line, pass). ``file, line, pass`` is the order in
which definitions are met; all "first" results follow it. The registry has one long row
per (category, name), never nested maps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.session import materialize, small

# Categories that names are looked up in, first one wins.
CATEGORIES = ("functions", "classes", "variables", "exports")
MAX_LOCATIONS = 5
ESTABLISHED = 5


def per_file(defs: DataFrame) -> DataFrame:
    """One row per (category, name, file): uses and first place in the file."""
    first = F.min(F.shiftleft(F.col("line").cast("long"), 32) + F.col("pass"))  # one long: no sort before the shuffle
    rows = defs.groupBy("category", "name", "file").agg(F.count("*").alias("usages"), first.alias("first"))
    place = F.struct(F.shiftright("first", 32).cast("int").alias("line"), F.col("first").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pass"))
    return rows.withColumn("first", place)


def locations(files: DataFrame, limit: int = MAX_LOCATIONS) -> DataFrame:
    """The first ``limit`` distinct files of each name. The rank filter prunes before the shuffle."""
    w = Window.partitionBy("category", "name").orderBy("file")
    rows = files.select("category", "name", "file", F.col("first.line").alias("line"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def entries(defs: DataFrame) -> DataFrame:
    """(category, name, file, line, pass, usages, namespace, files) of each name: all but its other places."""
    return _entries(per_file(defs))


def _entries(files: DataFrame) -> DataFrame:
    rows = files.groupBy("category", "name").agg(
        F.sum("usages").alias("usages"), F.count("*").alias("files"), F.min(F.struct("file", "first.line", "first.pass")).alias("f")
    )
    return rows.select("category", "name", "f.file", "f.line", "f.pass", "usages", T.namespace(F.col("f.file")).alias("namespace"), "files")


def registry(defs: DataFrame, limit: int = MAX_LOCATIONS) -> DataFrame:
    """Entries with their locations, which only names in several files have."""
    return of_contributions(per_file(defs), limit)


def of_contributions(files: DataFrame, limit: int = MAX_LOCATIONS) -> DataFrame:
    """The registry from its rows per (category, name, file)."""
    several = locations(files, limit).groupBy("category", "name").agg(F.sort_array(F.collect_list(F.struct("file", "line"))).alias("all"))
    out = _entries(files).join(several, ["category", "name"])
    return out.withColumn("locations", F.when(F.col("files") > 1, F.col("all"))).drop("all", "files")


#: Characters of text that a task counts at a time; a longer file is counted by itself.
PIECE = 1 << 23
TALLY = "name string, file string, line int, pass int, usages long, files long"


def _tally(pattern: str, most: int):
    find = re.compile(f"{pattern}|\n", re.A).findall

    def count(files: list[str], texts: list[str]) -> pa.RecordBatch:
        order = sorted(range(len(files)), key=files.__getitem__)
        files, found = [files[k] for k in order], [["\n", *find(texts[k])] for k in order]  # each line begins with its mark
        doc = np.repeat(np.arange(len(files)), [len(x) for x in found])
        code, names = pd.factorize(np.array(list(chain.from_iterable(found)), object))  # the mark is 0
        at = np.arange(len(code))
        mark = code == 0
        last = np.maximum.accumulate(np.where(mark, at, 0))  # the mark of each name's line
        lines = np.cumsum(mark)
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        line, pass_ = lines - lines[begins][doc] + 1, at - last - 1
        key, first = np.unique(code * len(files) + doc, return_index=True)  # by name, then file
        own = key // len(files)
        start = np.searchsorted(own, np.arange(len(names)))
        rank = np.arange(len(own)) - start[own]
        keep = (rank < most) & (own > 0)
        own, first, head = own[keep], first[keep], rank[keep] == 0
        columns = [
            pa.array(names[own], pa.string()), pa.array(files, pa.string()).take(pa.array(doc[first])), pa.array(line[first].astype(np.int32)), pa.array(pass_[first].astype(np.int32)),
            pa.array(np.where(head, np.bincount(code)[own], 0)), pa.array(np.where(head, np.diff(start, append=len(key))[own], 0)),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TALLY.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, texts, held = [], [], 0
        for b in batches:
            for file, text in zip(b.column(0), b.column(1)):
                files.append(file.as_py())
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= PIECE:
                    yield count(files, texts)
                    files, texts, held = [], [], 0
        if files:
            yield count(files, texts)

    return run


def tallies(files: DataFrame, pattern: str, most: int = 1) -> DataFrame:
    """(name, file, line, pass, usages, files) of the names that match ``pattern`` in files (file, text), by name.

    A task adds up some megabytes of files before anything moves, so a common name isn't a row a file. Of each name the
    ``most`` first of these files stay, with its first place there; its counts stand on one of these rows. Files that
    stand in several rows, or have no name, would be counted twice: they are counted by key. No match goes over a line's end.
    """
    several = materialize(files.groupBy("file").count().where("count > 1 or file is null").select("file"))
    if several.isEmpty():
        once, again = files, None
    else:
        keys = small(several)
        again = files.join(keys, files["file"].eqNullSafe(keys["file"]), "left_semi")
        once = files.join(keys, files["file"].eqNullSafe(keys["file"]), "left_anti")
    rows = once.where("text is not null").select("file", "text").mapInArrow(_tally(pattern, most), TALLY)
    if again is not None:
        lines = again.select("file", F.posexplode(T.lines(F.col("text"))).alias("at", "t"))
        defs = lines.select("file", (F.col("at") + 1).alias("line"), F.posexplode(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("pass", "name"))
        own = per_file(defs.withColumn("category", F.lit("")))
        rows = rows.unionByName(own.select("name", "file", "first.line", "first.pass", "usages", F.lit(1).cast("long").alias("files")))
    return rows.repartition("name")


def entries_of(rows: DataFrame, category: Column) -> DataFrame:
    """``entries`` of tallies."""
    first = F.min(F.struct("file", "line", "pass")).alias("f")
    out = rows.withColumn("category", category).groupBy("category", "name").agg(F.sum("usages").alias("usages"), F.sum("files").alias("files"), first)
    return out.select("category", "name", "f.file", "f.line", "f.pass", "usages", T.namespace(F.col("f.file")).alias("namespace"), "files")


def locations_of(rows: DataFrame, category: Column, limit: int = MAX_LOCATIONS) -> DataFrame:
    """``locations`` of tallies of ``limit`` places."""
    w = Window.partitionBy("category", "name").orderBy("file")
    places = rows.withColumn("category", category).select("category", "name", "file", "line")
    return places.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the first by ``order``. For routes and pages."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_first")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)])


def lookup(reg: DataFrame) -> DataFrame:
    """One row per name over the four categories, by precedence, with its order in the registry."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    rows = reg.where(F.col("category").isin(*CATEGORIES)).withColumn("cat_rank", rank)
    best = F.min(F.struct("cat_rank", "file", "line", "pass", "category", "usages", "namespace")).alias("b")
    return rows.groupBy("name").agg(best).select("name", "b.*")


def category_counts(reg: DataFrame) -> DataFrame:
    return reg.groupBy("category").agg(F.count("*").alias("symbols"))


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("lang").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def registry_meta(project: str, files: DataFrame, as_of: str, truncated: bool, depth_truncated: bool, max_files: int, max_depth: int) -> DataFrame:
    """The one row of facts about a scan."""
    return files.agg(F.count("*").alias("file_count")).select(
        F.lit(project).alias("project"),
        F.lit(as_of).cast("timestamp").alias("scanned"),
        "file_count",
        F.lit(truncated or depth_truncated).alias("incomplete"),
        F.lit(truncated).alias("truncated"),
        F.lit(depth_truncated).alias("depth_truncated"),
        F.lit(max_files).alias("max_files"),
        F.lit(max_depth).alias("max_depth"),
    )
