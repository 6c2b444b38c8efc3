"""Event analytics over ``events`` (user as symbol, event type as type) and a condensing log over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.operators import analytics

from .base import Catalog, table

_c = Catalog()
QUERIES, ORACLE = _c.queries, _c.oracle

EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS symbol, coalesce(regexp_extract(props, '([0-9]+)', 1), '') AS file, event_type AS type, ts, event_id AS seq FROM events),
newest AS (SELECT * FROM ev ORDER BY ts DESC, seq DESC LIMIT 500)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.coalesce(F.regexp_extract("props", "([0-9]+)", 1), F.lit(""))
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").cast("string").alias("symbol"), file.alias("file"), F.col("event_type").alias("type"), "ts", F.col("event_id").alias("seq"))


@_c.query(f"WITH {EV} SELECT * FROM newest")
def event_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.newest(events(spark, sf_dir))


@_c.query(f"""WITH {EV} SELECT symbol, count(*) AS count, arg_max(type, (ts, seq)) AS type, arg_max(ts, (ts, seq)) AS last_seen,
  count(DISTINCT CASE WHEN file <> '' THEN file END) AS files FROM newest GROUP BY symbol HAVING count(*) >= 3""")
def frequent_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.frequent(analytics.newest(events(spark, sf_dir)))


@_c.query(f"WITH {EV} SELECT symbol, count(*) AS count FROM newest GROUP BY symbol HAVING count(*) >= 3")
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.watchlist(analytics.newest(events(spark, sf_dir)))


@_c.query(f"WITH {EV} SELECT * FROM ev ORDER BY ts DESC, seq DESC LIMIT 10")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.recent(events(spark, sf_dir))


@_c.query(f"WITH {EV} SELECT type, count(*) AS count FROM ev GROUP BY type")
def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.by_type(events(spark, sf_dir))


@_c.query(f"""WITH {EV}, best AS (SELECT symbol, count(*) AS count, arg_max(type, (ts, seq)) AS type, arg_max(ts, (ts, seq)) AS last_seen,
  count(DISTINCT CASE WHEN file <> '' THEN file END) AS files FROM ev GROUP BY symbol HAVING count(*) >= 3 ORDER BY count DESC, symbol LIMIT 20),
f AS (SELECT symbol, file, min(seq) AS seq FROM ev WHERE file <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM f)
SELECT best.*, shown FROM best LEFT JOIN (SELECT symbol, string_agg(file, ', ' ORDER BY n) AS shown FROM r WHERE n <= 3 GROUP BY symbol) USING (symbol)""")
def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.report(events(spark, sf_dir))


LOG = r"""log AS (SELECT doc_id AS seq, source AS command, lang AS category, CAST(ceil(length(text) / 4.0) AS BIGINT) AS original_tokens,
  CAST(ceil(length(regexp_replace(text, '[ \t]+', ' ', 'g')) / 4.0) AS BIGINT) AS compressed_tokens FROM documents),
saved AS (SELECT *, greatest(0, original_tokens - compressed_tokens) AS saved FROM log)"""


def condensing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.col("source").alias("command"),
        F.col("lang").alias("category"),
        T.token_estimate(F.col("text")).alias("original_tokens"),
        T.token_estimate(F.regexp_replace("text", r"[ \t]+", " ")).alias("compressed_tokens"),
    )
    return analytics.condensing_log(rows)


@_c.query(f"""WITH {LOG} SELECT category, count(*) AS commands, CAST(sum(saved) AS BIGINT) AS tokens_saved, CAST(sum(original_tokens) AS BIGINT) AS original_tokens,
  CAST(grouping(category) AS TINYINT) AS is_total, CAST(floor(CAST(sum(saved) AS DOUBLE) / greatest(1, sum(original_tokens)) * 100 + 0.5) AS BIGINT) AS savings_pct FROM saved GROUP BY ROLLUP (category)""")
def compression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.condensing_stats(condensing_log(spark, sf_dir))


@_c.query(f"WITH {LOG}, last AS (SELECT * FROM saved ORDER BY seq DESC LIMIT 100) SELECT seq, command, category, original_tokens, compressed_tokens, saved FROM last ORDER BY saved DESC, seq LIMIT 5")
def top_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_commands(condensing_log(spark, sf_dir))


@_c.query("""WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS events, count(DISTINCT event_type) AS items FROM s GROUP BY user_id, g""")
def debounced_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.debounced(table(spark, sf_dir, "events"), "user_id", "12 hours", "event_type")


@_c.query("""SELECT event_id, json_keys(props)[1] AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value, '{ k: ' || json_extract_string(props, '$.k') || ' }' AS shape FROM events""")
def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symbolith.functions.documents import json_schema

    return table(spark, sf_dir, "events").select(
        "event_id", F.json_object_keys("props")[0].alias("key"), F.get_json_object("props", "$.k").cast("long").alias("value"), json_schema("props").alias("shape")
    )


@_c.query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(CAST(floor(s / 60.0) AS BIGINT) AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(CAST(floor(s / 3600.0) AS BIGINT) AS VARCHAR) || 'h ago'
  ELSE CAST(CAST(floor(s / 86400.0) AS BIGINT) AS VARCHAR) || 'd ago' END AS age,
  CASE WHEN floor(s / 86400.0) >= 7 THEN 'registry is ' || CAST(CAST(floor(s / 86400.0) AS BIGINT) AS VARCHAR) || ' days old; reindex before trusting unknown names' END AS note
FROM (SELECT event_id, epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS s FROM events)""")
def event_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00")
    return table(spark, sf_dir, "events").select("event_id", T.time_since(F.col("ts"), now).alias("age"), T.staleness_note(F.col("ts"), now).alias("note"))
