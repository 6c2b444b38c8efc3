"""Verdicts for queried names: known, fuzzy or unknown, with confidence.

Exact hits are one hash join. Only the rest is matched fuzzily, losslessly and without comparing every pair; the edit
distance verifies what meets by an equi-join. A name within ``k`` edits of a query contains at least one of the query's
``k + 1`` segments unchanged, shifted by at most the edits on either side of it. Where these segments would have fewer than SEGMENT letters, nearly all names
share one: such short queries (k <= 2) meet names by a deletion neighbourhood. Of two words within k edits, what is left
after at most k deletions from either is equal for some choice, and a short word has some fifty such rests at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.session import materialize, small

from .registry import ESTABLISHED


def block_candidates(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (q, name) that may lie within k edits; queries: (q, qkey, k), names: (name, nkey)."""
    queries = materialize(queries.where("k > 0"))
    few = queries.count() <= FEW
    q = queries.withColumn("len", F.char_length("qkey"))
    parts, base = F.col("k") + 1, F.floor(F.col("len") / (F.col("k") + 1)).cast("int")
    extra = F.col("len") - base * parts
    q = q.withColumns({"_base": base, "_long": extra.cast("int")}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    start = F.col("i") * F.col("_base") + F.greatest(F.col("i") - (F.col("k") + 1 - F.col("_long")), F.lit(0)) + 1
    size = F.col("_base") + F.when(F.col("i") >= F.col("k") + 1 - F.col("_long"), 1).otherwise(0)
    q = q.withColumns({"start": start.cast("int"), "size": size.cast("int")}).where("size > 0")
    q = q.withColumn("part", F.substring("qkey", F.col("start"), F.col("size")))
    q = q.withColumn("nlen", F.explode(F.sequence(F.greatest(F.col("len") - F.col("k"), F.lit(1)), F.col("len") + F.col("k"))))
    # some segment has as many edits before it as segments, so i and k - i bound its shift from either end
    back, longer = F.col("k") - F.col("i"), F.col("nlen") - F.col("len")
    q = q.withColumn("low", F.greatest(F.lit(1), F.col("start") - F.col("i"), F.col("start") + longer - back))
    q = q.withColumn("high", F.least(F.col("start") + F.col("i"), F.col("start") + longer + back)).where("low <= high")
    q = q.withColumn("at", F.explode(F.sequence("low", "high"))).select("q", "qkey", "k", "size", "nlen", "at", "part")
    sizes = q.select("size", "nlen").distinct()
    n = names.withColumn("nlen", F.char_length("nkey")).where("nlen > 0")
    n = n.join(F.broadcast(sizes), "nlen").where("size <= nlen")  # a handful of segment sizes, and only lengths that are asked for
    n = n.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("nlen") - F.col("size") + 1)))
    n = n.withColumn("part", F.substring("nkey", F.col("at"), F.col("size")))
    pairs = n.select("name", "nkey", "nlen", "at", "part").join(F.broadcast(q.drop("size")) if few else q.drop("size"), ["nlen", "at", "part"])
    return pairs.select("q", "qkey", "k", "name", "nkey").distinct()


#: Queries whose segments, some hundreds each, are broadcast at most.
FEW = 1000

#: Edits of a short query at most, and letters of a segment from which segments tell names apart.
SHORT, SEGMENT = 2, 3


def is_short() -> Column:
    return (F.col("k") <= SHORT) & (F.char_length("qkey") < SEGMENT * (F.col("k") + 1))


def deletions(rows: DataFrame, key: str, most: Column) -> DataFrame:
    """``rows`` with ``rest``, the hash of what is left of ``key`` after up to ``most`` deletions, SHORT at most; once for each rest."""
    n, text = F.char_length(key), F.col(key)
    cut = lambda x, at: F.concat(F.left(x, at - 1), F.substring(x, at + 1, F.char_length(x)))
    none = rows.withColumn("_left", text)
    one = rows.where((most >= 1) & (n >= 1)).withColumn("_at", F.explode(F.sequence(F.lit(1), n))).withColumn("_left", cut(text, F.col("_at")))
    # the second deletion stands at or behind the first
    two = one.where((most >= 2) & (n >= 2) & (F.col("_at") < n)).withColumn("_next", F.explode(F.sequence(F.col("_at"), n - 1)))
    two = two.withColumn("_left", cut(F.col("_left"), F.col("_next"))).drop("_next")
    all_ = none.unionByName(one.drop("_at")).unionByName(two.drop("_at"))
    return all_.withColumn("rest", F.xxhash64("_left")).drop("_left")


def deletion_candidates(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (q, name) that may lie within k edits, for k <= SHORT."""
    q = materialize(queries.where(F.col("k").between(1, SHORT)))
    # names whose length no query allows aren't looked at: there are few lengths
    lengths = q.select(F.explode(F.sequence(F.char_length("qkey") - F.col("k"), F.char_length("qkey") + F.col("k"))).alias("nlen")).distinct()
    n = names.join(F.broadcast(lengths), F.char_length("nkey") == F.col("nlen"), "left_semi")  # at most one row a length
    asked = small(deletions(q.select("q", "qkey", "k"), "qkey", F.col("k")).distinct())
    pairs = deletions(n.select("name", "nkey"), "nkey", F.lit(SHORT)).join(asked, "rest")
    return pairs.where(F.abs(F.char_length("qkey") - F.char_length("nkey")) <= F.col("k")).select("q", "qkey", "k", "name", "nkey").distinct()


def within_distance(queries: DataFrame, names: DataFrame, blocked: bool = True) -> DataFrame:
    """(q, k, name, distance) of all pairs within k edits."""
    if blocked:
        pairs = deletion_candidates(queries.where(is_short()), names).unionByName(block_candidates(queries.where(~is_short()), names))
    else:
        near = F.abs(F.char_length("qkey") - F.char_length("nkey")) <= F.col("k")
        pairs = queries.where("k > 0").join(names, near)
    d = F.levenshtein("qkey", "nkey")
    return pairs.withColumn("distance", d).where("distance <= k").select("q", "k", "name", "distance")


def _first(rows: DataFrame, *order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c != "q"]
    return rows.groupBy("q").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b")).select("q", "b.*")


def fuzzy(queries: DataFrame, known: DataFrame, blocked: bool = True) -> DataFrame:
    """Best fuzzy match of each distinct name in ``queries.q``; ties go to the earliest in the registry."""
    length = F.char_length("q")
    q = queries.select("q").distinct().withColumns({"qkey": F.lower("q"), "k": T.fuzzy_distance_limit(length)})
    pairs = within_distance(q, known.select("name", F.lower("name").alias("nkey")), blocked)
    rows = pairs.join(known, "name")
    best = _first(rows, *[F.col(c) for c in ("distance", "cat_rank", "file", "line", "pass", "name")])
    return best.select("q", "name", "distance", "k", T.fuzzy_confidence(F.col("distance"), F.col("k")).alias("confidence_pct"))


def verdicts(queries: DataFrame, known: DataFrame, blocked: bool = True) -> DataFrame:
    """One row per queried row: verdict, match, category, distance, confidence in hundredths.

    ``queries`` has ``q``; its other columns are kept and repeats are kept.
    """
    known = materialize(known)  # read by the exact join, the anti join and the fuzzy join
    distinct = queries.select("q").distinct()
    hits = distinct.join(known, distinct["q"] == known["name"]).select(
        "q",
        F.lit("known").alias("verdict"),
        F.col("name").alias("match"),
        "category",
        F.lit(0).alias("distance"),
        F.lit(100).alias("confidence_pct"),
        (F.col("usages") >= ESTABLISHED).alias("established"),
    )
    rest = distinct.join(known.select(F.col("name").alias("q")), "q", "left_anti")
    near = fuzzy(rest, known, blocked).join(known.select("name", "category"), "name")
    none = F.lit(None)
    near = near.select("q", F.lit("fuzzy").alias("verdict"), F.col("name").alias("match"), "category", "distance", "confidence_pct", none.cast("boolean").alias("established"))
    found = hits.unionByName(near)
    out = queries.join(found, "q", "left")
    return out.withColumns({"verdict": F.coalesce("verdict", F.lit("unknown")), "confidence_pct": F.coalesce("confidence_pct", F.lit(0))})


def summary(checked: DataFrame) -> DataFrame:
    """Counts by verdict and overall confidence over all queried rows, repeats included."""
    count = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)), F.lit(0)).cast("long").alias(v)
    mean = F.coalesce(F.floor(F.avg("confidence_pct") + 0.5), F.lit(0)).cast("long").alias("overall_confidence_pct")
    return checked.agg(F.count("*").alias("queried"), count("known"), count("fuzzy"), count("unknown"), mean)


def annotate(checked: DataFrame, watchlist: DataFrame, low: int = 70) -> DataFrame:
    """Adds how often a name was reported before and whether confidence is low."""
    seen = watchlist.select(F.col("symbol").alias("q"), F.col("count").alias("reported"))
    return checked.join(seen, "q", "left").withColumn("low_confidence", (F.col("verdict") == "fuzzy") & (F.col("confidence_pct") < low))


def report_lines(found: DataFrame, verbose: bool = False, low: int = 70) -> DataFrame:
    """(section, ord, text): what a reader sees of annotated verdicts with the place (file, line, usages, places) of their match.

    Sections follow each other by number: near names, unknown names, the summary, a hint where the whole is uncertain, and
    known names if asked for. A section without names has no head.
    """
    repeat = F.when(F.col("reported").isNotNull(), F.format_string(" [reported %d times]", "reported")).otherwise("")
    many = F.when(F.col("places") > 1, F.format_string(", defined in %d files", "places")).otherwise("")
    use = F.when(F.col("usages") > 5, ", well established").when(F.col("usages") == 1, ", rarely used").otherwise("")
    place = F.concat(F.col("category"), F.lit(", "), F.col("file"), F.lit(":"), F.col("line").cast("string"), many, use)
    near = F.concat(F.lit("- "), F.col("q"), F.lit(" -> "), F.col("match"), F.lit("? ("), F.col("confidence_pct").cast("string"), F.lit("% sure; "), place, F.lit(")"), repeat)
    star = F.when(F.col("established"), " *").otherwise("")
    named = F.concat(F.lit("- "), F.col("match"), F.lit(" ("), place, F.lit(")"), star)
    section = F.when(F.col("verdict") == "fuzzy", 0).when(F.col("verdict") == "unknown", 1).otherwise(4)
    text = F.when(F.col("verdict") == "fuzzy", near).when(F.col("verdict") == "unknown", F.concat(F.lit("- "), F.col("q"), repeat)).otherwise(named)
    rows = found.select(section.alias("section"), F.col("ord").cast("long").alias("ord"), text.alias("text"))
    rows = rows if verbose else rows.where("section < 4")
    title = F.when(F.col("section") == 0, "Possible typos").when(F.col("section") == 1, "Unknown names (new, renamed or made up)").otherwise("Known names")
    heads = rows.groupBy("section").count().select("section", F.lit(-1).cast("long").alias("ord"), F.format_string("%s (%d)", title, "count").alias("text"))
    whole = summary(found)
    sure = F.col("overall_confidence_pct")
    line = F.when((F.col("fuzzy") == 0) & (F.col("unknown") == 0), F.format_string("All %d names are in the registry (%d%% sure)", "known", sure)).otherwise(
        F.format_string("%d known, %d near, %d unknown; %d%% sure overall", "known", "fuzzy", "unknown", sure)
    )
    last = whole.select(F.explode(F.array(F.struct(F.lit(2).alias("section"), line.alias("text")), F.struct(F.lit(3).alias("section"), F.when(sure < low, "Much is uncertain: refresh the registry.").alias("text")))).alias("x"))
    last = last.select("x.section", F.lit(0).cast("long").alias("ord"), "x.text").where("text is not null")
    return rows.unionByName(heads).unionByName(last)


def report_json(found: DataFrame, notes: list[str] = []) -> DataFrame:
    """One row with the whole report as JSON: confidence, notes, and the names by verdict in the order they were asked."""

    def names(verdict: str, *fields: tuple[str, Column]) -> Column:
        own = F.when(F.col("verdict") == verdict, F.struct(F.col("ord"), *[c.alias(n) for n, c in fields]))
        rows = F.array_sort(F.collect_list(own))  # by the order, which comes first
        return F.transform(rows, lambda x: F.struct(*[x[n].alias(n) for n, _ in fields])).alias(verdict)

    col = F.col
    place = [("category", col("category")), ("file", col("file")), ("line", col("line"))]
    row = found.agg(
        F.coalesce(F.floor(F.avg("confidence_pct") + 0.5), F.lit(0)).alias("overall_confidence_pct"),
        names("known", ("name", col("match")), *place, ("established", col("established"))),
        names("fuzzy", ("queried", col("q")), ("suggestion", col("match")), ("confidence_pct", col("confidence_pct")), *place),
        names("unknown", ("name", col("q"))),
    )
    kept = F.array(*map(F.lit, notes)).cast("array<string>").alias("notes")
    return row.select(F.to_json(F.struct("overall_confidence_pct", kept, "known", "fuzzy", F.transform("unknown", lambda x: x["name"]).alias("unknown"))).alias("report"))


def events(checked: DataFrame, ts: str, session: int) -> DataFrame:
    """Events to append for names that weren't known."""
    return checked.where("verdict <> 'known'").select(
        F.col("q").alias("symbol"), F.lit("").alias("file"), F.col("verdict").alias("type"), F.lit(ts).cast("timestamp").alias("ts"), F.lit(session).cast("long").alias("session")
    )


def typos(queries: DataFrame, known: DataFrame, blocked: bool = True) -> DataFrame:
    """Best near name at similarity 0.85 or more, lengths at most 3 apart, case kept.

    ``known`` has (name, ord); equal similarities go to the smaller ord.
    """
    known = materialize(known)
    length = F.char_length("q")
    k = F.least(length, F.floor((length + 3) * 15 / 100)).cast("int")
    q = queries.select("q").distinct().withColumns({"qkey": F.col("q"), "k": k})
    names = known.select("name", F.col("name").alias("nkey"), "ord")
    pairs = within_distance(q, names.drop("ord"), blocked).join(names.select("name", "ord"), "name")
    longer = F.greatest(length, F.char_length("name"))
    pairs = pairs.where((F.abs(length - F.char_length("name")) <= 3) & (F.col("distance") * 100 <= longer * 15))
    pairs = pairs.withColumn("longer", longer)
    best = _first(pairs, F.col("distance") / F.col("longer"), F.col("ord"))
    return best.select("q", "name", "distance", F.floor((1 - F.col("distance") / F.col("longer")) * 100 + 0.5).cast("int").alias("similarity_pct"))
