"""Reference checks over ``pages`` as files with links; those over scripts are in ``project``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.operators import references

from .base import Catalog, table

_c = Catalog()
QUERIES, ORACLE = _c.queries, _c.oracle

def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))


PATHS = "paths AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages), hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


@_c.query(f"WITH {PATHS} SELECT DISTINCT page_id, href FROM hrefs WHERE href NOT IN (SELECT path FROM paths)")
def link_targets_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hrefs(spark, sf_dir).distinct().join(url_paths(spark, sf_dir).select(F.col("path").alias("href")).distinct(), "href", "left_anti").select("page_id", "href")


ROUTES = rf"""{PATHS}, lits AS (SELECT DISTINCT '/api' || href AS literal FROM hrefs UNION SELECT DISTINCT '/api' || path FROM paths UNION SELECT '/api/fr/77777' UNION SELECT '/api/open/x/y'),
routes AS (SELECT DISTINCT 'GET' AS method, '/api' || CASE WHEN page_id % 3 = 0 THEN regexp_replace(path, '/[0-9]+$', '/:id') ELSE path END AS path FROM paths WHERE page_id % 2 = 0
  UNION SELECT 'MOUNT', '/api/open' UNION SELECT 'MOUNT', '/api/en'),
p AS (SELECT path FROM routes WHERE method <> 'MOUNT'), m0 AS (SELECT path FROM routes r WHERE method = 'MOUNT' AND NOT EXISTS (SELECT 1 FROM p WHERE p.path = r.path OR starts_with(p.path, r.path || '/'))),
l AS (SELECT literal, regexp_replace(literal, '/$', '') AS a FROM lits),
w AS (SELECT *, array_to_string(list_transform(string_split(a, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '*' ELSE s END), '/') AS w FROM l)"""


@_c.query(f"""WITH {ROUTES} SELECT literal FROM w WHERE a NOT IN (SELECT path FROM p) AND w NOT IN (SELECT regexp_replace(path, '/:[A-Za-z_][A-Za-z0-9_]*', '/*', 'g') FROM p)
 AND NOT EXISTS (SELECT 1 FROM p WHERE starts_with(p.path, a || '/')) AND NOT EXISTS (SELECT 1 FROM m0 WHERE a = m0.path OR starts_with(a, m0.path || '/'))""")
def route_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = url_paths(spark, sf_dir)
    known = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("path", r"/[0-9]+\z", "/:id")).otherwise(F.col("path"))
    routes = paths.where("page_id % 2 = 0").select(F.lit("GET").alias("method"), F.concat(F.lit("/api"), known).alias("path")).distinct()
    routes = routes.unionByName(spark.createDataFrame([("MOUNT", "/api/open"), ("MOUNT", "/api/en")], "method string, path string"))
    api = lambda c: F.concat(F.lit("/api"), c).alias("literal")
    literals = hrefs(spark, sf_dir).select(api(F.col("href"))).unionByName(paths.select(api(F.col("path"))))
    literals = literals.unionByName(spark.createDataFrame([("/api/fr/77777",), ("/api/open/x/y",)], "literal string")).distinct()
    return references.bad_routes(literals, routes)


@_c.query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), '(?m)//.*$', '', 'g'), '(?s)`(?:[^`\\]|\\.)*`', '""', 'g'),
  '(?s)"(?:[^"\\]|\\.)*"', '""', 'g'), '(?s)''(?:[^''\\]|\\.)*''', '''''', 'g') AS code FROM documents""")
def strip_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_comments_and_strings(F.col("text")).alias("code"))
