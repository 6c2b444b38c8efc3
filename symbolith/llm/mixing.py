"""Mixing sources to target weights by capped water-filling.

Each source may be repeated up to ``max_epochs`` times. Targets start in proportion to
the weights; a source whose target exceeds its cap is clamped there and the excess goes
to the others by weight, until none is above. The sample is seeded: a source with
target ``t`` and size ``s`` takes each document ``floor(t / s)`` times, and once more
the documents whose seeded hash comes first, up to the fraction that is left.

Sources are a table, in any number: they are numbered by a range sort, and each round of the
filling is one aggregate of which two sums reach the driver.

The cut of the fraction is found exactly and without sorting a source. Rows of one hash, id and
size are one *lot*, counted before they move. Sizes are summed by (source, leading hash bits),
the bin in which the cut falls is opened by the next bits, and only that small bin is
ordered. Of the one lot in which the cut falls, a part of the rows is taken, numbered by their
place in the materialised rows, partition by partition. So a source with a third of all rows, or
that many equal rows, never meets in one task, and what a source takes misses its target by at
most half of one document.

Defined cases: a null source is a source of its own, last in order; a null or empty text
has size 0 and takes 0; equal hashes are ordered by id; rows of equal id, text and source are
interchangeable, and each of them is taken by itself; extra columns are kept, result columns
replace columns of the same names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small, text_of

BITS = 12


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def _draw(seed: int, id_col: str, text_col: str) -> Column:
    """63 seeded hash bits of a row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)), 1)


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``_rank``, from 0: by code point, null last."""
    order = [F.col("_source").isNull(), F.col("_source")]
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(sources.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_part", before.alias("_before")))  # one row a partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.join(sizes, "_part").withColumn("_rank", (F.col("_before") + own).cast("long")).drop("_part", "_before")


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """``sources`` with ``weight``: the cycle's weights in turn, by code point, null last."""
    at = F.pmod(F.col("_rank"), F.lit(len(cycle))).cast("int") + 1
    return numbered(sources).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), at)).drop("_rank")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: in proportion to weights, none above max_epochs times its size."""
    cap = (F.col("source_size") * float(max_epochs)).cast("double")
    rows = materialize(sources.withColumns({"_cap": cap, "weight": F.coalesce("weight", F.lit(0.0)).cast("double")}))
    counts, level, clamped = F.col("weight") > 0, 0.0, F.lit(False)
    while True:  # the level only rises, and each round but the last clamps a source more
        weights, caps = rows.agg(F.sum(F.when(counts & ~clamped, F.col("weight"))), F.sum(F.when(counts & clamped, F.col("_cap")))).first()
        if not weights:
            break
        level = (budget - (caps or 0.0)) / weights
        over = counts & (F.col("weight") * F.lit(float(level)) > F.col("_cap"))
        if rows.where(over & ~clamped).isEmpty():
            break
        clamped = clamped | over
    target = F.when(~counts, 0.0).when(clamped, F.col("_cap")).otherwise(F.col("weight") * F.lit(float(level)))
    return rows.withColumn("target", target).drop("_cap")


def _before(by: str) -> Column:
    return F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _cut(sums: DataFrame, by: str, need: str) -> DataFrame:
    """The bin of each source in which the cut falls, and what is needed of it."""
    sums = sums.withColumn("_under", _before(by)).where(f"_under < {need} and _under + _n >= {need}")
    return materialize(sums.select(F.col("_source").alias("_s"), F.col(by).alias("_bin"), (F.col(need) - F.col("_under")).alias("_need")))


def _first_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_s, _until): place of the last row that is taken; ``wanted``: (_s, _many) rows of each source.

    Rows are counted by partition of the materialised rows; only the partition of the cut is numbered.
    """
    rows = rows.join(small(wanted), _same("_source", "_s")).withColumn("_part", F.shiftright("_place", 33))
    sums = rows.groupBy("_source", "_part", "_many").agg(F.count("*").alias("_n"))
    at = sums.withColumn("_under", _before("_part")).where("_under < _many and _under + _n >= _many")
    at = at.select(F.col("_source").alias("_t"), F.col("_part").alias("_p"), "_under")
    inside = rows.join(small(at), _same("_source", "_t") & (F.col("_part") == F.col("_p")))
    number = F.row_number().over(Window.partitionBy("_source").orderBy("_place"))
    return inside.withColumn("_number", number + F.col("_under")).where("_number = _many").select("_s", F.col("_place").alias("_until"))


def _planned(df: DataFrame, weigh: Callable[[DataFrame], DataFrame], share: float, max_epochs: int, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` as (_id, _source, size, _u, _place), and what each source takes."""
    rows = materialize(
        df.select(
            F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("size"),
            _draw(seed, id_col, text_col).alias("_u"), F.monotonically_increasing_id().alias("_place"),
        )
    )
    sources = materialize(rows.groupBy("_source").agg(F.sum("size").alias("source_size")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goals = water_fill(weigh(sources), share * total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.select(F.col("_source").alias("_s"), "source_size", "target", whole.alias("_whole"))
    goals = materialize(goals.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))

    top, next_ = F.shiftright("_u", 63 - BITS), F.shiftrightunsigned(F.shiftleft("_u", BITS + 1), 64 - BITS)
    bins = rows.groupBy("_source", top.alias("_b")).agg(F.sum("size").alias("_n")).join(small(goals.where("_rest > 0")), _same("_source", "_s")).drop("_s")
    first = _cut(bins, "_b", "_rest")
    inside = rows.join(small(first), _same("_source", "_s") & (top == F.col("_bin"))).select("_source", "_u", "_id", "size", next_.alias("_b"), "_need")
    bins = inside.groupBy("_source", "_b", "_need").agg(F.sum("size").alias("_n"))
    second = _cut(bins, "_b", "_need")
    lots = inside.drop("_need").join(small(second), _same("_source", "_s") & (F.col("_b") == F.col("_bin")))
    lots = lots.groupBy("_source", "_u", "_id", "size", "_need").agg(F.count("*").alias("_rows"))
    lots = lots.withColumn("_n", F.col("size") * F.col("_rows"))
    under = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_u", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = lots.withColumn("_under", under).where("_under < _need and _under + _n >= _need")
    many = F.round((F.col("_need") - F.col("_under")) / F.col("size")).cast("long")
    edge = materialize(lots.select(F.col("_source").alias("_e"), F.col("_u").alias("_cut_u"), F.col("_id").alias("_cut_id"), "_rows", many.alias("_many")))
    goals = goals.join(edge, _same("_s", "_e"), "left").drop("_e")
    parted = edge.where("_many > 0 and _many < _rows")
    twins = rows.join(small(parted.select(F.col("_e").alias("_es"), "_cut_u", "_cut_id")), _same("_source", "_es") & (F.col("_u") == F.col("_cut_u")) & _same("_id", "_cut_id"))
    until = _first_of(twins.select("_source", "_place"), parted.select(F.col("_e").alias("_s"), "_many")).withColumnRenamed("_s", "_e")
    return rows, materialize(goals.join(materialize(until), _same("_s", "_e"), "left").drop("_e"))


def _epochs(place: str) -> Column:
    """How often a row is taken, beside its source's goals."""
    at = F.struct("_u", "_id")
    cut = F.struct(F.col("_cut_u").alias("_u"), F.col("_cut_id").alias("_id"))
    lot = F.when(F.col("_many") <= 0, False).when(F.col("_many") >= F.col("_rows"), True).otherwise(F.col(place) <= F.col("_until"))
    more = F.when(at.eqNullSafe(cut), lot).otherwise(at < cut)
    return F.col("_whole") + F.when(F.col("_cut_u").isNotNull() & (F.col("size") > 0), more.cast("long")).otherwise(0)


def plan(
    df: DataFrame,
    weigh: Callable[[DataFrame], DataFrame] = cyclic_weights,
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Narrow rows (_id, _source, size, source_size, target, taken, _epochs) of every row of ``df``.

    ``weigh`` adds ``weight`` to the sources (_source, source_size).
    """
    rows, goals = _planned(df, weigh, share, max_epochs, seed, id_col, text_col, source_col)
    out = rows.join(small(goals), _same("_source", "_s")).withColumn("_epochs", _epochs("_place"))
    return out.select("_id", "_source", "size", "source_size", "target", (F.col("_epochs") * F.col("size")).alias("taken"), "_epochs")


def mix(
    df: DataFrame,
    weigh: Callable[[DataFrame], DataFrame] = cyclic_weights,
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: rows of ``df``, each as often as the plan takes it, numbered by ``epoch``.

    Rows without words are in no epoch that counts and are left out. Each row is decided where it is,
    from its source's goals; only rows of lots in which a cut falls are written down to be numbered.
    """
    _, goals = _planned(df, weigh, share, max_epochs, seed, id_col, text_col, source_col)
    df = df.drop("epoch")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    own = df.select(
        row, _draw(seed, id_col, text_col).alias("_u"), F.col(id_col).alias("_id"),
        word_count(text_col).alias("size"), F.col(source_col).alias("_source"),
    ).where("size > 0")
    own = own.join(small(goals), _same("_source", "_s"))
    parted = F.coalesce(F.struct("_u", "_id").eqNullSafe(F.struct(F.col("_cut_u").alias("_u"), F.col("_cut_id").alias("_id"))) & (F.col("_many") > 0) & (F.col("_many") < F.col("_rows")), F.lit(False))
    plain = own.where(~parted).select("_row", _epochs("_until").alias("epochs"))
    twins = own.where(parted).select("_row", "_source", "_u", "_id", "size", *[c for c in goals.columns if c != "_until"]).withColumn("_place", F.monotonically_increasing_id())
    if goals.where("_many > 0 and _many < _rows").isEmpty():
        out = plain
    else:
        twins = materialize(twins)
        until = _first_of(twins.select("_source", "_place"), goals.where("_many > 0 and _many < _rows").select("_s", "_many")).withColumnRenamed("_s", "_e")
        out = plain.unionByName(twins.join(small(until), _same("_source", "_e"), "left").select("_row", _epochs("_place").alias("epochs")))
    out = out.where("epochs > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))).alias("_epoch"))
    return out.select(*[F.col(f"_row.`{c}`") for c in df.columns], F.col("_epoch").alias("epoch"))
