"""Condensing over ``documents`` as captured outputs; reports of outputs made of their words are in ``outputs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.functions import documents as D
from symbolith.functions import text as T
from symbolith.operators import condense, reports

from .base import Catalog, table

_c = Catalog()
QUERIES, ORACLE = _c.queries, _c.oracle

LINES = """lns AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""
BARE = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condense.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@_c.query(f"""WITH {LINES}, b AS (SELECT *, CASE WHEN text IS NOT DISTINCT FROM lag(text) OVER w AND lag(line_no) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM lns WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY line_no) AS run FROM b)
SELECT doc, min(line_no) AS line_no, any_value(text) AS text, count(*) AS n, any_value(text) || ' [×' || count(*) || ']' AS condensed FROM r GROUP BY doc, run HAVING count(*) >= 3""")
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condense.adjacent_runs(_doc_lines(spark, sf_dir))


KEY = BARE.format(x="text")
for _p in (r"^\[?[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[0-9.Z:+-]*\]?\s*", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}", r"^[0-9]{10,13}\s+"):
    KEY = f"regexp_replace({KEY}, '{_p}', '')"
KEY = BARE.format(x=KEY)
for _p, _v in ((r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"), (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "<IP>"), (r"\b[0-9a-f]{24,}\b", "<ID>")):
    KEY = f"regexp_replace({KEY}, '{_p}', '{_v}', 'gi')"


@_c.query(f"""WITH {LINES}, k AS (SELECT doc, line_no, {KEY} AS key, {BARE.format(x='text')} AS text FROM lns WHERE regexp_matches(text, '\\S'))
SELECT doc, key, count(*) AS n, arg_min(text, line_no) AS first_line, min(line_no) AS line_no FROM k GROUP BY doc, key""")
def log_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log_groups(_doc_lines(spark, sf_dir))


@_c.query(r"""SELECT doc_id, regexp_replace(chr(27) || '[31m' || text || chr(27) || '[0m', chr(27) || '\[[0-?]*[ -/]*[@-~]', '', 'g') AS text FROM documents""")
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    coloured = F.concat(F.lit("\x1b[31m"), "text", F.lit("\x1b[0m"))
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_ansi(coloured).alias("text"))


NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\r\n', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g')"


@_c.query(f"SELECT doc_id, {NORMAL.format(x='text')} AS text FROM documents")
def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@_c.query("""SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 1200) || chr(10) || chr(10) || '... [' || (length(text) - 1800) || ' chars / ~'
  || CAST(floor((length(text) - 1800) / 4.0 + 0.5) AS BIGINT) || ' tokens omitted] ...' || chr(10) || chr(10) || right(text, 600) END AS text FROM documents""")
def smart_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", condense.smart_truncate(F.col("text")).alias("text"))


@_c.query(f"SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(greatest(0, floor((1 - CAST(length({NORMAL.format(x='text')}) AS DOUBLE) / nullif(length(text), 0)) * 100 + 0.5)) AS INT) AS savings FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(text).alias("tokens"), T.savings_percent(T.normalize_whitespace(text), text).alias("savings"))


# Written apart from the engine's own list, in DuckDB's notation.
_KEYS = "(?i)(api_key|apikey|secret|token|password|passwd)(?-i)"
_SECRET = "text || chr(10) || 'API_KEY=' || md5(text) || ' password=short'"
for _k, _p in (
    ("PRIVATE_KEY", "(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"), ("OPENAI_KEY", r"sk-(proj-)?[\w-]{20,}"), ("GITHUB_TOKEN", "gh[oprsu]_[0-9A-Za-z]{36,}"),
    ("AWS_KEY", "A[KS]IA[0-9A-Z]{16}"), ("STRIPE_KEY", "(sk|rk)_(live|test)_[0-9A-Za-z]{16,}"), ("SLACK_TOKEN", "xox[abprs]-[0-9A-Za-z-]{10,}"), ("NPM_TOKEN", "npm_[0-9A-Za-z]{36}"),
    ("CONNECTION_STRING", r"[a-z][0-9a-z+]*://[^\s:/@]+:[^\s:/@]+@\S+"), ("BEARER", "Bearer [0-9A-Za-z._~+/=-]{16,}"), ("SECRET", _KEYS + r"""\s*[:=]\s*["''][^"''\s]{6,}["'']"""), ("SECRET", _KEYS + r"""=[^\s"''&,;\[]{8,}"""),
):
    _SECRET = f"regexp_replace({_SECRET}, '{_p}', '[REDACTED:{_k}]', 'g')"


@_c.query(f"SELECT doc_id, {_SECRET} AS text, CAST(len(regexp_extract_all({_SECRET}, '\\[REDACTED:')) AS INT) AS redactions FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit("\nAPI_KEY="), F.md5("text"), F.lit(" password=short"))
    rows = table(spark, sf_dir, "documents").select("doc_id", condense.redact(text).alias("text"))
    return rows.withColumn("redactions", condense.redactions(F.col("text")))


@_c.query(r"""SELECT doc_id, regexp_replace(text, '([][.*+?^${}()|\\])', '\\\1', 'g') AS escaped, CAST(to_json(text) AS VARCHAR) AS quoted,
  coalesce(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))[1], '') AS first_line, 1 - levenshtein(lang, source) / greatest(length(lang), length(source)) AS alike FROM documents""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for a pattern and for a configuration file, their first visible line, and how alike two names are."""
    text = F.col("text")
    alike = T.similarity(F.col("lang"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_regex(text).alias("escaped"), T.toml_string(text).alias("quoted"), T.first_line(text).alias("first_line"), alike.alias("alike"))


@_c.query()
def group_similar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.per_document(lambda x: D.group_similar(x)[0], "string")
    return table(spark, sf_dir, "documents").select("doc_id", f("text").alias("text"))


@_c.query()
def identifier_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.per_document(lambda x: D.rename(x, "the", "THE"), "string")
    return table(spark, sf_dir, "documents").select("doc_id", f("text").alias("text"))
