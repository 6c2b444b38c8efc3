"""Registry and checking over the driver tables.

A document is a file below the directory of its source; identifiers in its lines are
definitions: capitalised ones classes, others functions. Words of benchmark items are the
queried names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.operators import check, registry
from symbolith.session import materialize

from .base import Catalog, table

_c = Catalog()
QUERIES, ORACLE = _c.queries, _c.oracle
NAME = "[A-Za-z_][A-Za-z0-9_]{2,}"


def file_name() -> F.Column:
    return F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))


def tallies(spark: SparkSession, sf_dir: str, most: int = 1) -> DataFrame:
    return registry.tallies(table(spark, sf_dir, "documents").select(file_name().alias("file"), "text"), NAME, most)


def category() -> F.Column:
    return F.when(F.col("name").rlike("^[A-Z]"), "classes").otherwise("functions")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.entries_of(tallies(spark, sf_dir), category())


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_extract_all("text", F.lit(NAME), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(names).alias("pos", "q"))


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.lookup(entries(spark, sf_dir))


DEFS = f"""
lns AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS file, unnest(string_split(text, chr(10))) AS t,
               generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
defs AS (SELECT file, line, unnest(regexp_extract_all(t, '{NAME}')) AS name,
                generate_subscripts(regexp_extract_all(t, '{NAME}'), 1) - 1 AS pass FROM lns),
cat AS (SELECT *, CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'classes' ELSE 'functions' END AS category FROM defs),
per_file AS (SELECT category, name, file, count(*) AS usages, min((line, pass)) AS first FROM cat GROUP BY ALL),
reg AS (SELECT category, name, CAST(sum(usages) AS BIGINT) AS usages, count(*) AS files, min((file, first)) AS f FROM per_file GROUP BY ALL),
known AS (SELECT name, arg_min(category, (CASE category WHEN 'functions' THEN 1 ELSE 2 END)) AS category,
                 arg_min(usages, (CASE category WHEN 'functions' THEN 1 ELSE 2 END)) AS usages,
                 min((CASE category WHEN 'functions' THEN 1 ELSE 2 END, f)) AS ord FROM reg GROUP BY name),
asked AS (SELECT item_id, unnest(regexp_extract_all(text, '{NAME}')) AS q, generate_subscripts(regexp_extract_all(text, '{NAME}'), 1) - 1 AS pos FROM benchmark),
rest AS (SELECT DISTINCT q, CASE WHEN length(q) < 3 THEN 0 WHEN length(q) < 5 THEN 1 ELSE greatest(2, CAST(floor(length(q) * 0.3) AS INT)) END AS k
         FROM asked WHERE q NOT IN (SELECT name FROM known)),
near AS (SELECT q, k, name, levenshtein(lower(q), lower(name)) AS distance, ord, category FROM rest JOIN known
         ON abs(length(q) - length(name)) <= k AND k > 0 WHERE levenshtein(lower(q), lower(name)) <= k),
best AS (SELECT q, any_value(k) AS k, arg_min(name, (distance, ord, name)) AS name, arg_min(distance, (distance, ord, name)) AS distance,
                arg_min(category, (distance, ord, name)) AS category FROM near GROUP BY q),
fuzzy AS (SELECT q, name, distance, k, CAST(floor((0.3 + 0.4 * (1.0 - CAST(distance AS DOUBLE) / k)) * 100 + 0.5) AS INT) AS confidence_pct, category FROM best),
checked AS (SELECT item_id, pos, asked.q,
    CASE WHEN known.name IS NOT NULL THEN 'known' WHEN fuzzy.q IS NOT NULL THEN 'fuzzy' ELSE 'unknown' END AS verdict,
    coalesce(known.name, fuzzy.name) AS "match", coalesce(known.category, fuzzy.category) AS category,
    CASE WHEN known.name IS NOT NULL THEN 0 ELSE fuzzy.distance END AS distance,
    CASE WHEN known.name IS NOT NULL THEN 100 ELSE coalesce(fuzzy.confidence_pct, 0) END AS confidence_pct,
    known.usages >= 5 AS established
  FROM asked LEFT JOIN known ON asked.q = known.name LEFT JOIN fuzzy ON asked.q = fuzzy.q)
"""


@_c.query(f"WITH {DEFS} SELECT category, name, f[1] AS file, f[2][1] AS line, usages, split_part(f[1], '/', 1) AS namespace, files FROM reg")
def symbol_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).drop("pass")


@_c.query(f"""WITH {DEFS}, ranked AS (SELECT category, name, file, first[1] AS line, row_number() OVER (PARTITION BY category, name ORDER BY file) AS rank FROM per_file)
SELECT category, name, file, line, rank FROM ranked WHERE rank <= 5""")
def registry_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.locations_of(tallies(spark, sf_dir, registry.MAX_LOCATIONS), category())


@_c.query(f"WITH {DEFS} SELECT category, count(*) AS symbols FROM reg GROUP BY category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.category_counts(tallies(spark, sf_dir).select(category().alias("category"), "name").distinct())


@_c.query("""SELECT doc_id, CASE WHEN source IN ('apps', 'packages', 'services') THEN source || '/' || doc_id ELSE source END AS namespace FROM documents
UNION ALL SELECT page_id, 'root' FROM pages WHERE NOT contains(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/')
UNION ALL SELECT page_id, split_part(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/', 1) FROM pages WHERE contains(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/')""")
def symbol_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.namespace(file_name()).alias("namespace"))
    path = F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1)
    return docs.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), T.namespace(path).alias("namespace")))


@_c.query(f'WITH {DEFS} SELECT item_id, pos, q, verdict, "match", category, distance, confidence_pct, established FROM checked')
def check_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.verdicts(asked(spark, sf_dir), known_names(spark, sf_dir)).select(
        "item_id", "pos", "q", "verdict", "match", "category", "distance", "confidence_pct", "established"
    )


@_c.query(f"WITH {DEFS} SELECT DISTINCT q, category, usages FROM asked JOIN known ON q = name")
def known_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = asked(spark, sf_dir).select("q").distinct()
    known = known_names(spark, sf_dir)
    return names.join(known, names["q"] == known["name"]).select("q", "category", "usages")


@_c.query(f"WITH {DEFS} SELECT DISTINCT q FROM rest WHERE q NOT IN (SELECT q FROM fuzzy)")
def unknown_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.verdicts(asked(spark, sf_dir).select("q").distinct(), known_names(spark, sf_dir)).where("verdict = 'unknown'").select("q")


@_c.query(f"WITH {DEFS} SELECT q, name, distance, k, confidence_pct FROM fuzzy")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialize(known_names(spark, sf_dir))
    rest = asked(spark, sf_dir).select("q").distinct().join(known.select(F.col("name").alias("q")), "q", "left_anti")
    return check.fuzzy(rest, known)


@_c.query(f"""WITH {DEFS} SELECT count(*) AS queried, count(*) FILTER (verdict = 'known') AS known, count(*) FILTER (verdict = 'fuzzy') AS fuzzy,
  count(*) FILTER (verdict = 'unknown') AS "unknown", CAST(floor(avg(confidence_pct) + 0.5) AS BIGINT) AS overall_confidence_pct FROM checked""")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.summary(check.verdicts(asked(spark, sf_dir), known_names(spark, sf_dir)))


@_c.query(f"""WITH {DEFS}, sim AS (SELECT q, name, levenshtein(q, name) AS distance, greatest(length(q), length(name)) AS longer
  FROM rest JOIN known ON abs(length(q) - length(name)) <= 3 WHERE levenshtein(q, name) * 100 <= greatest(length(q), length(name)) * 15)
SELECT q, arg_min(name, (CAST(distance AS DOUBLE) / longer, name)) AS name, arg_min(distance, (CAST(distance AS DOUBLE) / longer, name)) AS distance,
  CAST(floor((1 - min(CAST(distance AS DOUBLE) / longer)) * 100 + 0.5) AS INT) AS similarity_pct FROM sim GROUP BY q""")
def typo_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialize(known_names(spark, sf_dir))
    rest = asked(spark, sf_dir).select("q").distinct().join(known.select(F.col("name").alias("q")), "q", "left_anti")
    return check.typos(rest, known.select("name", F.col("name").alias("ord")))


@_c.query(f"""WITH {DEFS} SELECT q AS symbol, '' AS file, verdict AS type, TIMESTAMP '2024-02-01 00:00:00' AS ts, CAST(1 AS BIGINT) AS session
FROM checked WHERE verdict <> 'known'""")
def record_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = check.events(check.verdicts(asked(spark, sf_dir), known_names(spark, sf_dir)), "2024-02-01 00:00:00", 1)
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_c.query(f"""WITH {DEFS}, seen AS (SELECT q AS symbol, count(*) AS n FROM asked GROUP BY q HAVING count(*) >= 3)
SELECT item_id, pos, q, verdict, n AS reported, verdict = 'fuzzy' AND confidence_pct < 70 AS low_confidence FROM checked LEFT JOIN seen ON q = symbol""")
def check_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = asked(spark, sf_dir)
    seen = names.groupBy(F.col("q").alias("symbol")).count().where("count >= 3")
    return check.annotate(check.verdicts(names, known_names(spark, sf_dir)), seen).select("item_id", "pos", "q", "verdict", "reported", "low_confidence")
