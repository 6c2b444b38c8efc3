"""URL allow and block rules by a sort-merge range join.

A host is turned round label by label (``www.example.com`` -> ``com.example.www.``), so a
rule for a host and its subdomains is the interval of keys that start with the rule's own
key. Intervals of two rules are nested or disjoint. Sampled splitters deal urls out by
(key, path, id): a host with a third of all urls is spread over many partitions. Each rule
goes to every partition that its interval meets. In a partition, rules and urls are sorted
by key and swept once; a stack holds the rules whose intervals are open, innermost last,
and each host on the stack looks up the url's path among its path prefixes. The longest
rule (host and path together; at a tie the longer host) gives the verdict.

To the driver come ``SAMPLES`` keys a partition, a fixed number, and nothing else.

Defined cases: a null url or one without ``://`` has an empty host and path; a null or
empty rule host fits every host, a null rule path every path; of rules with equal host and
path block wins; repeated urls each get their row; extra columns of the pages are dropped,
of the rules ignored; no pages give no rows, no rules give the default verdict everywhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SAMPLES = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _place(key: str, path: str, page: object) -> str:
    return f"{key}\0{path}\0{page}"


def _splitters(urls: DataFrame, parts: int, seed: int) -> list[str]:
    n = urls.count()
    if n == 0 or parts < 2:
        return []
    want = SAMPLES * parts
    rows = urls.select("key", "path", "page_id").sample(min(1.0, 1.2 * want / n), seed).limit(2 * want).collect()
    keys = sorted(_place(*r) for r in rows)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _deal_urls(cuts: list[str]):
    """Puts a range's number behind the columns, which pass through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pid = [bisect_right(cuts, _place(*x)) for x in zip(*(b[c].to_pylist() for c in ("key", "path", "page_id")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pid, pa.int32())], [*b.schema.names, "pid"])

    return run


def _deal_rules(cuts: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            everywhere = b["host"] == ""
            b["key"] = b["key"].where(~everywhere, "")
            b["lo"] = [bisect_right(cuts, k) for k in b["key"]]
            b["hi"] = [bisect_right(cuts, k[:-1] + "/") if k else len(cuts) for k in b["key"]]
            yield b

    return run


class _Open:
    """The rules of one host while its interval is open."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.lengths = key, host, {}, []

    def add(self, path: str, action: str) -> None:
        self.paths[path] = action
        self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def match(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.paths), None)


def _sweep(default: str):
    def verdict(stack: list[_Open], path: str) -> tuple[str | None, str]:
        best, found = -1, (None, default)
        for o in reversed(stack):
            got = o.match(path)
            if got is not None and len(o.host) + len(got) > best:
                best, found = len(o.host) + len(got), (o.host + got, o.paths[got])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        pid = None
        for batch in batches:
            c = batch.to_pydict()
            out: dict[str, list] = {k: [] for k in ("page_id", "host", "path", "rule", "verdict")}
            for p, key, is_url, page, host, path, action in zip(c["pid"], c["key"], c["is_url"], c["page_id"], c["host"], c["path"], c["action"]):
                if p != pid:
                    stack, pid = [], p
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1].key != key:
                        stack.append(_Open(key, host))
                    stack[-1].add(path, action)
                    continue
                rule, said = verdict(stack, path)
                for k, v in zip(out, (page, host, path, rule, said)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=OUT)

    return run


OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow", seed: int = 5) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``; rules: (host, path, action)."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    cuts = _splitters(urls, parts, seed)
    urls = urls.mapInArrow(_deal_urls(cuts), "page_id long, host string, path string, key string, pid int")
    own = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    own = own.withColumn("host", F.translate("host", UPPER, LOWER)).groupBy("host", "path").agg(F.max("action").alias("action"))
    own = own.withColumn("key", host_key(F.col("host")))
    own = own.mapInPandas(_deal_rules(cuts), "host string, path string, action string, key string, lo int, hi int")
    own = own.withColumn("pid", F.explode(F.sequence("lo", "hi")))
    none = lambda kind: F.lit(None).cast(kind)
    both = urls.select("pid", "key", F.lit(True).alias("is_url"), "page_id", "host", "path", none("string").alias("action")).unionByName(
        own.select("pid", "key", F.lit(False).alias("is_url"), none("long").alias("page_id"), "host", "path", "action")
    )
    swept = both.repartitionById(parts, "pid").sortWithinPartitions("pid", "key", "is_url")
    return swept.mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")
