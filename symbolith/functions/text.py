"""Scalar column functions. All stay on the JVM side.

Regular expressions are written for Java: ``\\z`` for the end of a text, ASCII look-arounds
for word boundaries. Halves are rounded up with ``floor(x + 0.5)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that trimming removes.
SPACE = "\t\n\x0b\f\r \u00a0\ufeff\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u1680"

# Roots under which a namespace has two path segments.
TWO_LEVEL_ROOTS = ("apps", "packages", "services")

# Terminal escape sequences.
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def lines(x: Column) -> Column:
    return F.split(x, "\n", -1)


def fuzzy_distance_limit(length: Column) -> Column:
    """Edits allowed for a queried name of this length."""
    return F.when(length < 3, 0).when(length < 5, 1).otherwise(F.greatest(F.lit(2), F.floor(length * 0.3).cast("int")))


def fuzzy_confidence(distance: Column, limit: Column) -> Column:
    """Hundredths: 70 for distance 0 down to 30 at the limit."""
    return half_up((F.lit(0.3) + F.lit(0.4) * (F.lit(1.0) - distance / limit)) * 100).cast("int")


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b))


def namespace(path: Column) -> Column:
    """First path segment, two below the two-level roots, ``root`` for a bare name."""
    p = F.split(path, r"[/\\]", -1)
    return F.when(F.size(p) < 2, "root").when(p[0].isin(*TWO_LEVEL_ROOTS), F.concat_ws("/", p[0], p[1])).otherwise(p[0])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]", -1), -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)).otherwise(".")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)\z", 1)


def normalized_route(path: Column) -> Column:
    return F.regexp_replace(path, r"/:[A-Za-z_][A-Za-z0-9_]*", "/*")


def wildcard_route(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/", -1), lambda s: F.when(s.rlike(r"^[0-9]+\z"), "*").otherwise(s)), "/")


def strip_ansi(x: Column) -> Column:
    return F.regexp_replace(x, ANSI, "")


def _quoted(mark: str) -> str:
    """A quoted string; possessive, so that its length costs neither stack nor second tries."""
    return rf"(?s){mark}[^{mark}\\]*+(?:\\.[^{mark}\\]*+)*+{mark}"


def strip_comments_and_strings(code: Column) -> Column:
    for pattern, new in (
        (r"(?s)/\*.*?\*/", ""),
        (r"(?m)//.*$", ""),
        (_quoted("`"), '""'),
        (_quoted('"'), '""'),
        (_quoted("'"), "''"),
    ):
        code = F.regexp_replace(code, pattern, new)
    return code


def normalize_whitespace(x: Column) -> Column:
    """LF line ends, at most one blank line, no white space at line ends or around the text."""
    x = F.regexp_replace(x, "\r\n", "\n")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return trim(F.array_join(F.transform(lines(x), lambda r: F.rtrim(r, F.lit(" \t"))), "\n"))


def token_estimate(x: Column) -> Column:
    return F.ceil(F.char_length(x) / 4).cast("long")


def savings_percent(new: Column, old: Column) -> Column:
    """Whole percent saved, not below 0; NULL for an empty original."""
    ratio = F.char_length(new) / F.nullif(F.char_length(old), F.lit(0))
    return F.greatest(F.lit(0), half_up((1 - ratio) * 100)).cast("int")


def short_command(x: Column) -> Column:
    return F.when(F.char_length(x) > 80, F.concat(F.substring(x, 1, 77), F.lit("..."))).otherwise(x)


def time_since(ts: Column, as_of: Column) -> Column:
    """Age in words: just now, minutes, hours, days; NULL without a time."""
    s = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "just now").when(s < 3600, part(60, "m ago")).when(s < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


def escape_regex(x: Column) -> Column:
    return F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1")


# Times that a log line begins with, and what stands for ids and addresses in it.
LOG_TIMES = (
    r"^\[?[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[0-9.Z:+-]*\]?\s*",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}",
    r"^[0-9]{10,13}\s+",
)
LOG_MASKS = (
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"(?<![A-Za-z0-9_])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![A-Za-z0-9_])", "<IP>"),
    (r"(?i)(?<![A-Za-z0-9_])[0-9a-f]{24,}(?![A-Za-z0-9_])", "<ID>"),
)


def log_key(line: Column) -> Column:
    """A log line without leading times, with ids and addresses masked.

    Lines that can't have a time, or a mark of seven characters or more, aren't searched for one.
    """
    x = bare = trim(line)
    for p in LOG_TIMES:
        x = F.regexp_replace(x, p, "")
    x = F.when(bare.rlike(r"^[0-9\[]"), trim(x)).otherwise(bare)
    masked = x
    for p, name in LOG_MASKS:
        masked = F.regexp_replace(masked, p, name)
    return F.when(x.rlike(r"[0-9]\.[0-9]|[0-9A-Fa-f]{8}"), masked).otherwise(x)


def staleness_note(scanned: Column, as_of: Column, days: int = 7) -> Column:
    age = F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(scanned.cast("timestamp"))) / 86400)
    return F.when(age >= days, F.concat(F.lit("registry is "), age.cast("string"), F.lit(" days old; reindex before trusting unknown names")))


def incomplete_note(truncated: Column, depth_truncated: Column) -> Column:
    """Why a registry may miss symbols; NULL if the scan was complete."""
    parts = F.array_compact(F.array(F.when(truncated, F.lit("file limit reached")), F.when(depth_truncated, F.lit("depth limit reached"))))
    return F.when(F.size(parts) > 0, F.concat(F.lit("registry is incomplete: "), F.array_join(parts, ", ")))


def first_line(x: Column) -> Column:
    return F.coalesce(F.get(F.filter(lines(x), lambda s: s.rlike(r"\S")), F.lit(0)), F.lit(""))


def toml_string(x: Column) -> Column:
    return F.to_json(F.struct(x.alias("v"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(x.alias("v")))) - 6)


def toml_table_name(line: Column) -> Column:
    """Name in a ``[table]`` header without quotes; NULL for other lines."""
    name = F.regexp_extract(line, r"^\s*\[([^\[\]]+)\]\s*(?:#.*)?\z", 1)
    return F.when(name != "", F.regexp_replace(trim(name), "[\"']", ""))
