"""Extraction over ``pages``, and overviews of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.operators import extract, registry, report
from symbolith.sources import files as scan_files

from .base import Catalog, table

_c = Catalog()
QUERIES, ORACLE = _c.queries, _c.oracle
@_c.query(r"""SELECT page_id, CASE WHEN t = '' THEN page_id || '.html' ELSE t END AS title, CAST(len(list_filter(regexp_extract_all(html, '(?is)<script[^>]+src\s*=\s*["'']([^"'']+)["''][^>]*>', 1),
  lambda x: NOT starts_with(x, 'http') AND NOT starts_with(x, '//'))) AS INT) AS scripts
FROM (SELECT page_id, html, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1), '^\s+|\s+$', '', 'g') AS t FROM pages)""")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "html", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    found = extract.pages(rows, "path", "html")
    return found.select(F.regexp_extract("file", r"^(\d+)", 1).cast("long").alias("page_id"), "title", F.size("scripts").alias("scripts"))


@_c.query("""WITH p AS (SELECT page_id, html, split_part(html, '<script>', 1) AS above FROM pages)
SELECT 'variables' AS category, 't' AS name, CAST(page_id AS VARCHAR) AS file, CAST(1 + length(above) - length(replace(above, chr(10), '')) AS INT) AS line, 0 AS pass FROM p WHERE contains(html, '<script>var t=')""")
def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return extract.page_scripts(rows)


@_c.query("""SELECT lang, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang""")
def lang_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.language_breakdown(table(spark, sf_dir, "documents").select("lang", F.size(T.lines(F.col("text"))).alias("lines")))


@_c.query("""WITH f AS (SELECT source AS dir, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name, row_number() OVER (ORDER BY source, lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS n FROM documents)
SELECT dir, count(*) AS files, count(*) FILTER (n <= 100) AS shown, count(*) FILTER (n <= 100) < count(*) AS partial FROM f GROUP BY dir HAVING count(*) FILTER (n <= 100) > 0""")
def file_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"))
    return report.tree(files, 100).select("dir", "files", "shown", "partial")


# --- Scans: documents as Python files below their source ---


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".py"))
    rows = table(spark, sf_dir, "documents")
    return rows.select(name.alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime"), F.col("text").alias("content"), "doc_id")


FILES = "files AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.py' AS path, CAST(strlen(text) AS BIGINT) AS size, text, doc_id FROM documents)"


@_c.query(f"""WITH {FILES}, ok AS (SELECT *, row_number() OVER (ORDER BY path) AS ord, count(*) OVER () AS n FROM files WHERE size <= 512000)
SELECT path, 'python' AS lang, CAST(len(string_split(text, chr(10))) AS INT) AS lines, size, CAST(ord AS INT) AS ord, n > 100 AS truncated, false AS depth_truncated FROM ok WHERE ord <= 100""")
def scan_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_files.scan(files_of(spark, sf_dir).drop("doc_id"), max_files=100)
    return rows.select("path", "lang", "lines", "size", "ord", "truncated", "depth_truncated")


@_c.query(f"""WITH {FILES}, cache AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size, doc_id FROM files WHERE doc_id % 7 <> 0 UNION ALL SELECT 'gone.py', 1, -1)
SELECT f.path, CASE WHEN c.path IS NULL THEN 'parse' ELSE 'reuse' END AS status FROM files f LEFT JOIN cache c ON f.path = c.path AND f.size = c.size""")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, sf_dir)
    size = F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))
    none = F.array().cast("array<struct<category:string,name:string,line:int,pass:int>>")
    cache = files.where("doc_id % 7 <> 0").withColumns({"size": size, "symbols": none, "version": F.lit(scan_files.CACHE_VERSION)})
    gone = cache.limit(1).withColumns({"path": F.lit("gone.py"), "size": F.lit(1).cast("long")})
    changed, held = scan_files.incremental(files, cache.unionByName(gone))
    return changed.select("path", F.lit("parse").alias("status")).unionByName(held.select("path", F.lit("reuse").alias("status")))


@_c.query(r"""SELECT page_id, lower(regexp_extract(url, '^[^?#]*?(\.[^./?#]*)?([?#].*)?$', 1)) AS extension,
  CASE WHEN regexp_matches(url, '^[^?#]*\.html([?#]|$)') THEN 'html' END AS lang FROM pages""")
def language_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1)).alias("extension"), extract.language(path).alias("lang"))
