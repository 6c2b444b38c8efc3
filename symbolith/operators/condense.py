"""Condensing captured outputs: line operators as relations, and the whole chain per output.

Relations of lines carry (doc, line_no, text): order is explicit, and a document's lines are the
only rows that a window gathers. Reports of tests, diagnostics, logs and builds are such
relations (``reports``). The rest of the chain of :func:`condense` works on one output at a time, an Arrow-batched UDF over outputs.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from symbolith.functions import documents as D
from symbolith.functions import text as T
from symbolith.session import materialize

from . import reports as R

# Markers of redacted secrets and what they stand for, in order.
SECRETS = (
    ("PRIVATE_KEY", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("OPENAI_KEY", r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}"),
    ("GITHUB_TOKEN", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("AWS_KEY", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("STRIPE_KEY", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("SLACK_TOKEN", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("NPM_TOKEN", r"npm_[A-Za-z0-9]{36}"),
    ("CONNECTION_STRING", r"[a-z][a-z0-9+]*://[^\s:/@]+:[^\s:/@]+@[^\s]+"),
    ("BEARER", r"Bearer [A-Za-z0-9._~+/=-]{16,}"),
    ("SECRET", r"(?i:api_key|apikey|secret|token|password|passwd)\s*[=:]\s*[\"'][^\"'\s]{6,}[\"']"),
    # without quotes, as in an environment: nothing that is redacted already
    ("SECRET", r"(?i:api_key|apikey|secret|token|password|passwd)=[^\s\"'\[&;,]{8,}"),
)

# Commands by category, in the order in which categories are tried.
TEST, LINT = ("jest", "vitest", "pytest", "rspec"), ("tsc", "eslint", "ruff", "biome", "rubocop", "golangci-lint")
FILE = ("ls", "dir", "tree", "cat", "type", "find")
BUILD = (
    "make", "cmake", "gradle", "gradlew", "mvn", "maven", "bazel", "webpack", "vite", "esbuild", "rollup", "turbo", "nx", "terraform", "tofu", "prisma",
)


def redact(x: Column) -> Column:
    for kind, pattern in SECRETS:
        x = F.regexp_replace(x, pattern, f"[REDACTED:{kind}]")
    return x


def redactions(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\[REDACTED:"))


def words_of(command: Column) -> Column:
    """Words of a command after its leading assignments."""
    all_ = F.split(T.trim(command), r"\s+")
    first = F.array_position(F.transform(all_, lambda w: ~w.contains("=")), True)
    return F.when(first == 0, F.array(F.lit(""))).otherwise(F.slice(all_, first.cast("int"), F.size(all_)))


def command_category(command: Column) -> Column:
    w = words_of(command)
    base, a, b = F.lower(w[0]), F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.coalesce(F.get(w, F.lit(2)), F.lit(""))
    rest = F.lower(F.array_join(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), " "))
    node, other = base.isin("npm", "yarn", "pnpm"), base.isin("yarn", "pnpm")
    runs = lambda what: (a == what) | ((a == "run") & (b == what))
    return (
        F.when(base.isin("git", "gh", "hub"), "git")
        .when(base.isin(*TEST) | ((base == "npm") & runs("test")) | ((other | base.isin("cargo", "go")) & (a == "test")), "test")
        .when(base.isin(*LINT) | ((base == "cargo") & (a == "clippy")), "lint")
        .when(base.isin(*FILE), "file")
        .when((base == "jq") | rest.contains("--json") | rest.contains("-o json"), "json")
        .when(base.isin("tail", "head", "journalctl") | ((base == "docker") & (a == "logs")), "log")
        .when(
            base.isin(*BUILD)
            | ((base == "docker") & a.isin("build", "buildx"))
            | ((base == "dotnet") & a.isin("build", "publish", "restore"))
            | (base.isin("cargo", "go") & (a == "build"))
            | (node & runs("build")),
            "build",
        )
        .when(node | base.isin("pip", "cargo"), "package")
        .otherwise("unknown")
    )


def strip_progress(x: Column) -> Column:
    """Without progress, percent, download and carriage-return lines."""
    noise = (
        rf"^(?=.*[{D.BAR_SURE.replace('[', chr(92) + '[')}])[{D.BAR.replace('[', chr(92) + '[')}]+\z",
        r"^[0-9]+%",
        r"(?i)^(?:Downloading|Collecting|Installing|Building|Resolving)(?=.*\.\.\.)",
        r"^[.#]+\z",
    )

    def keep(line: Column) -> Column:
        bare = T.trim(line)
        bad = line.contains("\r")
        for p in noise:
            bad = bad | bare.rlike(p)
        return ~bad

    return F.array_join(F.filter(T.lines(F.regexp_replace(x, "\r\n", "\n")), keep), "\n")


def smart_truncate(x: Column, max_tokens: int = 500) -> Column:
    room = max_tokens * 4
    head, tail = room * 6 // 10, room * 3 // 10
    gone = F.char_length(x) - head - tail
    notice = F.concat(F.lit("\n\n... ["), gone.cast("string"), F.lit(" chars / ~"), T.half_up(gone / 4).cast("string"), F.lit(" tokens omitted] ...\n\n"))
    return F.when(F.char_length(x) <= room, x).otherwise(F.concat(F.substring(x, 1, head), notice, F.right(x, F.lit(tail))))


def generic(x: Column, max_tokens: int = 500) -> Column:
    return smart_truncate(T.normalize_whitespace(strip_progress(T.strip_ansi(x))), max_tokens)


# --- Relations of lines ------------------------------------------------------


def explode_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    return df.select(F.col(doc).alias("doc"), F.posexplode(T.lines(F.col(text))).alias("line_no", "text"))


def adjacent_runs(lines: DataFrame, least: int = 3) -> DataFrame:
    """Runs of equal adjacent lines: (doc, line_no, text, n, condensed); shorter runs keep n rows."""
    w = Window.partitionBy("doc").orderBy("line_no")
    rows = lines.withColumn("new", (~F.col("text").eqNullSafe(F.lag("text").over(w)) | F.lag("doc").over(w).isNull()).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w))
    runs = rows.groupBy("doc", "run").agg(F.min("line_no").alias("line_no"), F.first("text").alias("text"), F.count("*").alias("n"))
    label = F.concat("text", F.lit(" [×"), F.col("n").cast("string"), F.lit("]"))
    return runs.where(F.col("n") >= least).select("doc", "line_no", "text", "n", label.alias("condensed"))


def status_entries(lines: DataFrame) -> DataFrame:
    """Files of a status report with the section that they stand in."""
    bare = T.trim(F.col("text"))
    section = F.lit(None).cast("string")
    for head, name in D.STATUS.items():
        section = F.when(bare.startswith(head), name).otherwise(section)
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"bare": bare, "head": section}).withColumn("section", F.last("head", ignorenulls=True).over(w))
    change = r"^(new file|modified|deleted|renamed|both modified|both added):\s+(.+)\z"
    entry = F.when(
        F.col("bare").rlike(change) & (F.col("section") != "untracked"), F.concat_ws(": ", F.regexp_extract("bare", change, 1), F.regexp_extract("bare", change, 2))
    ).when((F.col("section") == "untracked") & ~F.col("bare").rlike(change), F.col("bare"))
    skip = F.col("head").isNotNull() | F.col("bare").startswith("(use ") | (F.col("bare") == "") | F.col("bare").startswith("On branch") | F.col("bare").startswith("Your branch")
    return rows.where(~skip).withColumn("entry", entry).where("entry is not null and section is not null").select("doc", "line_no", "section", "entry")


def log_commits(lines: DataFrame) -> DataFrame:
    """Commits of a log in blocks: short hash and first line of the message."""
    hash_ = F.nullif(F.regexp_extract("text", r"^commit\s+([a-f0-9]+)", 1), F.lit(""))
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.col("text").rlike(r"\S")).withColumn("hash", hash_).withColumn("block", F.count("hash").over(w)).where("block > 0")
    bare = T.trim(F.col("text"))
    message = F.when(F.col("hash").isNull() & ~bare.startswith("Author:") & ~bare.startswith("Date:"), F.struct("line_no", bare.alias("m")))
    out = rows.groupBy("doc", "block").agg(F.substring(F.first("hash", ignorenulls=True), 1, 7).alias("hash"), F.min(message).alias("m"))
    return out.select("doc", F.col("block").cast("int").alias("block"), "hash", F.coalesce("m.m", F.lit("")).alias("message"))


# --- The whole chain ---------------------------------------------------------

CONDENSED = Y.StructType(
    [
        Y.StructField("original_chars", Y.LongType()),
        Y.StructField("original_tokens", Y.LongType()),
        Y.StructField("compressed_chars", Y.LongType()),
        Y.StructField("compressed_tokens", Y.LongType()),
        Y.StructField("savings_percent", Y.LongType()),
        Y.StructField("output", Y.StringType()),
        Y.StructField("skipped", Y.BooleanType()),
    ]
)
LEAST_TOKENS, LEAST_SAVING = 50, 10


def condense_one(category: str, args: list[str], base: str, clean: str, raw_chars: int, max_tokens: int, report: str | None = None) -> tuple:
    """The chain for one output that is free of escapes and secrets already; ``report``: of its lines, if its category has one."""
    tokens = -(-len(clean) // 4)
    if tokens < LEAST_TOKENS and category != "git":
        out, pct = D.generic(clean, max_tokens)
    else:
        files = {"tree": D.tree_listing, "cat": D.file_content, "type": D.file_content}
        try:
            got = D.git(clean, args) if category == "git" else files.get(base, D.dir_listing)(clean) if category == "file" else D.json_report(clean) if category == "json" else None
        except Exception:  # a parser that gives up leaves the text to the generic one
            got = None
        if report is not None:
            got = report, D.saved(report, clean) if clean.strip() else 100
        out, pct = got or D.generic(clean, max_tokens)
        if category != "git":
            for step in (D.collapse_runs, D.group_similar):
                new, n = step(out)
                if n:
                    out, pct = new, D.saved(new, clean)
    skipped = category != "git" and pct < LEAST_SAVING
    if skipped:
        out, pct = clean, 0
    return raw_chars, tokens, len(out), -(-len(out) // 4), pct, out, skipped


def condense(df: DataFrame, command: str = "command", raw: str = "raw", max_tokens: int = 500, redacted: bool = True) -> DataFrame:
    """``df`` with category, redacted_count and the condensed output as a struct.

    A NULL output counts as empty. Escapes and secrets go natively first, so no UDF sees them. Reports of tests, diagnostics,
    logs and builds are relations of lines (``reports``), made once for equal outputs, which a hash of 128 bits tells apart.
    """

    def run(category: pd.Series, words: pd.Series, clean: pd.Series, chars: pd.Series, report: pd.Series) -> pd.DataFrame:
        rows = [condense_one(c, list(w)[1:], w[0].lower() if len(w) else "", x, n, max_tokens, r) for c, w, x, n, r in zip(category, words, clean, chars, report)]
        return pd.DataFrame(rows, columns=[f.name for f in CONDENSED])

    run.__annotations__ = {"category": pd.Series, "words": pd.Series, "clean": pd.Series, "chars": pd.Series, "report": pd.Series, "return": pd.DataFrame}
    text = F.coalesce(F.col(raw), F.lit(""))
    bare = T.strip_ansi(text)
    rows = df.withColumns({"category": command_category(F.col(command)), "_w": words_of(F.col(command)), "_bare": bare, "_n": F.char_length(text)})
    rows = rows.withColumns({"_clean": redact(F.col("_bare")) if redacted else F.col("_bare")})
    rows = rows.withColumn("redacted_count", (redactions(F.col("_clean")) - redactions(F.col("_bare"))).cast("long"))
    rows = rows.withColumn("_key", F.when(F.col("category").isin(*R.REPORTS), F.md5("_clean")))
    texts = rows.where("_key is not null").groupBy("category", "_key").agg(F.first("_clean").alias("_clean"))
    lines = materialize(explode_lines(texts.withColumn("_doc", F.concat_ws(":", "category", "_key")), "_doc", "_clean"))  # each report reads them several times
    made = None
    for name, report in R.REPORTS.items():
        own = materialize(report(lines.where(F.col("doc").startswith(f"{name}:"))))
        made = own if made is None else made.unionByName(own)
    made = made.select(F.col("doc").alias("_made_of"), F.col("out").alias("_report"))
    rows = rows.join(made, F.concat_ws(":", "category", "_key") == F.col("_made_of"), "left")
    rows = rows.withColumn("condensed", F.pandas_udf(run, CONDENSED)("category", "_w", "_clean", "_n", "_report"))
    return rows.drop("_w", "_bare", "_clean", "_n", "_key", "_made_of", "_report")
