"""Tables whose versions change at once, and small text sinks.

A table is a folder. Each write makes a folder ``v=<id>`` of its own and then moves one pointer file,
``_pointer-<number>``, into place; it names the folders that are the table, and their schema. Readers follow
the highest pointer, so a write that dies halfway leaves the old table as it was. Of two writers that start from
the same pointer one wins, since a pointer is never replaced; the other gets a ``Conflict``, or, where its change doesn't
depend on what it read, goes again behind the first. Folders and pointers older than the last KEEP versions are removed by
the next write; what died halfway is removed by ``vacuum``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symbolith.functions import text as T

#: Versions whose files stay for readers that are under way.
KEEP = 2
#: Folders of appended rows, beyond which an append rewrites them as one.
COMPACT = 32


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read."""


class _Folder:
    """A table's folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        at = self._at("")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A file that appears whole, and only where there was none."""
        tmp = self._at(f"_tmp-{uuid.uuid4().hex}")
        stream = self.fs.create(tmp)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(tmp, self._at(name), none)
        except Py4JJavaError as e:
            self.fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.path}/{name} is there") from None
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _pointer(folder: _Folder) -> tuple[int, dict | None]:
    """Number and content of the newest pointer; (0, None) if there is none."""
    numbers = [int(m[1]) for n in folder.names() if (m := re.fullmatch(r"_pointer-(\d+)", n))]
    if not numbers:
        return 0, None
    return max(numbers), json.loads(folder.text(f"_pointer-{max(numbers):012}"))


def _move(folder: _Folder, number: int, pointer: dict) -> None:
    """Make ``pointer`` the table's, if nobody else has moved it since ``number``; then remove what is too old."""
    folder.put(f"_pointer-{number + 1:012}", json.dumps(pointer))
    names = folder.names()
    numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"_pointer-(\d+)", n)))
    parts = {n: {p.split("/")[0] for p in json.loads(folder.text(f"_pointer-{n:012}"))["parts"]} for n in numbers[-KEEP - 8 :]}
    held = set().union(*(parts[n] for n in numbers[-KEEP:]))
    for n in numbers[-KEEP - 8 : -KEEP]:
        for old in parts[n] - held:
            folder.remove(old)
        folder.remove(f"_pointer-{n:012}")


def _save(df: DataFrame, folder: _Folder, buckets: str | None = None) -> list[str]:
    """Write rows into a new folder; the parts that it has."""
    name = f"v=n{uuid.uuid4().hex}"
    writer = df.write.partitionBy(buckets) if buckets else df.write
    writer.parquet(f"{folder.path}/{name}")
    if not buckets:
        return [name]
    inner = _Folder(df.sparkSession, f"{folder.path}/{name}").names()
    return [f"{name}/{x}" for x in inner if x.startswith(f"{buckets}=")]


def _schema(df: DataFrame, buckets: str | None = None) -> str:
    """The schema as it is read back: the bucket stands last."""
    return df.select(*[c for c in df.columns if c != buckets], *([buckets] if buckets else [])).schema.json()


def write(df: DataFrame, path: str, buckets: str | None = None) -> None:
    """Replace a table; ``buckets`` is an integer column by which ``replace_buckets`` can change parts of it."""
    folder = _Folder(df.sparkSession, path)
    number, _ = _pointer(folder)
    parts = _save(df, folder, buckets)
    while True:
        try:
            return _move(folder, number, {"parts": parts, "schema": _schema(df, buckets), "buckets": buckets, "seq": 0})
        except Conflict:  # the last to replace a table wins
            number, _ = _pointer(folder)


def append(df: DataFrame, path: str) -> None:
    """Add rows; rows that are added at the same time all stay."""
    folder = _Folder(df.sparkSession, path)
    parts = _save(df, folder)
    while True:
        number, now = _pointer(folder)
        old = now or {"parts": [], "seq": 0}
        try:
            _move(folder, number, {"parts": [*old["parts"], *parts], "schema": (now or {}).get("schema") or _schema(df), "buckets": None, "seq": old["seq"]})
            break
        except Conflict:
            continue
    if len(old["parts"]) >= COMPACT:
        _compact(df.sparkSession, path)


def _compact(spark: SparkSession, path: str) -> None:
    """Write appended rows as one folder, unless somebody else changes the table meanwhile."""
    folder = _Folder(spark, path)
    number, now = _pointer(folder)
    parts = _save(_load(spark, path, now), folder)
    try:
        _move(folder, number, now | {"parts": parts})
    except Conflict:
        folder.remove(parts[0])


def append_numbered(df: DataFrame, path: str, seq: str = "seq") -> None:
    """Add rows with numbers in ``seq`` above all that the table ever had; no two rows share one, whoever writes."""
    folder = _Folder(df.sparkSession, path)
    while True:
        number, now = _pointer(folder)
        old = now or {"parts": [], "seq": 0}
        rows = df.withColumn(seq, F.monotonically_increasing_id() + F.lit(old["seq"] + 1))
        parts = _save(rows, folder)
        top = df.sparkSession.read.parquet(f"{folder.path}/{parts[0]}").agg(F.max(seq)).first()[0]
        try:
            _move(folder, number, {"parts": [*old["parts"], *parts], "schema": (now or {}).get("schema") or _schema(rows), "buckets": None, "seq": top or old["seq"]})
            break
        except Conflict:  # the numbers are taken: number the rows again
            folder.remove(parts[0])
    if len(old["parts"]) >= COMPACT:
        _compact(df.sparkSession, path)


def replace_buckets(df: DataFrame, path: str, touched: Iterable[int]) -> None:
    """Put ``df`` in the place of the rows of the touched buckets; the others aren't read or written."""
    folder = _Folder(df.sparkSession, path)
    number, now = _pointer(folder)
    if now is None or not now["buckets"]:
        raise LookupError(f"{path} has no buckets")
    gone = {f"{now['buckets']}={b}" for b in touched}
    parts = [p for p in now["parts"] if p.split("/")[1] not in gone]
    _move(folder, number, now | {"parts": [*parts, *_save(df, folder, now["buckets"])]})


def _load(spark: SparkSession, path: str, pointer: dict) -> DataFrame:
    schema = StructType.fromJson(json.loads(pointer["schema"]))
    if not pointer["parts"]:
        return spark.createDataFrame([], schema)
    base = path.rstrip("/")
    rows = spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{p}" for p in pointer["parts"]))
    return rows.select(*schema.names)


def read(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> tuple[str, DataFrame | None]:
    """('ok', table), ('missing', None) or ('corrupt', None). A table is missing until its first write is whole."""
    folder = _Folder(spark, path)
    try:
        _, now = _pointer(folder)
        if now is None:
            odd = [n for n in folder.names() if not n.startswith(("v=", "_tmp-", "."))]
            return ("corrupt" if odd else "missing"), None
        df = _load(spark, path, now)
        df.limit(1).collect()
    except Exception:  # a pointer that isn't JSON, or files that aren't Parquet or are gone
        return "corrupt", None
    return ("ok", df) if set(needed) <= set(df.columns) else ("corrupt", None)


def read_buckets(spark: SparkSession, path: str, some: Iterable[int]) -> DataFrame:
    """The rows of some buckets; files of others aren't opened."""
    _, now = _pointer(_Folder(spark, path))
    if now is None or not now["buckets"]:
        raise LookupError(f"{path} has no buckets")
    wanted = {f"{now['buckets']}={b}" for b in some}
    return _load(spark, path, now | {"parts": [p for p in now["parts"] if p.split("/")[1] in wanted]})


def clear(spark: SparkSession, path: str) -> None:
    """Leave no rows; numbers that were given aren't given again."""
    folder = _Folder(spark, path)
    while True:
        number, now = _pointer(folder)
        if now is None:
            return None
        try:
            return _move(folder, number, now | {"parts": []})
        except Conflict:
            continue


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove folders that no pointer names. To be called while nobody writes."""
    folder = _Folder(spark, path)
    names = folder.names()
    held = {p.split("/")[0] for n in names if n.startswith("_pointer-") for p in json.loads(folder.text(n))["parts"]}
    gone = [n for n in names if (n.startswith("v=") and n not in held) or n.startswith("_tmp-")]
    for n in gone:
        folder.remove(n)
    return gone


def bucket_of(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


BLOCK_START, BLOCK_END = "<!-- symbols:start -->", "<!-- symbols:end -->"


def upsert_block(existing: str, block: str, start: str = BLOCK_START, end: str = BLOCK_END) -> str:
    """``existing`` with the marked block replaced, or put at its end."""
    new = f"{start}\n{block}\n{end}"
    marked = re.compile(re.escape(start) + ".*?" + re.escape(end), re.S)
    if marked.search(existing):
        return marked.sub(lambda _: new, existing, count=1)
    return f"{existing.rstrip()}\n\n{new}\n" if existing.strip() else new + "\n"


def server_entries(configs: DataFrame) -> DataFrame:
    """(source, name) of the servers in JSON and TOML configurations (source, kind, content)."""
    names = F.map_keys(F.from_json(F.get_json_object("content", "$.mcpServers"), "map<string,string>"))
    json = configs.where("kind = 'json'").select("source", F.explode(names).alias("name"))
    toml = configs.where("kind = 'toml'").select("source", F.explode(T.lines(F.col("content"))).alias("line"))
    toml = toml.withColumn("name", F.regexp_extract(T.toml_table_name(F.col("line")), r"^mcp_servers\.([^.]+)", 1)).where("name <> ''")
    return json.unionByName(toml.select("source", "name")).distinct()


def redundant_servers(servers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Servers (source, name, command, scope, score) that another of the same profile replaces.

    profiles: (profile, pattern). The best score is kept, ties by ``source:name``; only servers of
    the repository's own scope may go.
    """
    rows = servers.crossJoin(F.broadcast(profiles)).where(F.expr("concat_ws(' ', name, command) rlike pattern"))  # a fixed list of patterns
    key = F.concat_ws(":", "source", "name")
    best = rows.groupBy("profile").agg(F.count("*").alias("n"), F.min_by(key, F.struct(-F.col("score"), key)).alias("keeper")).where("n > 1")
    return rows.join(best, "profile").where((key != F.col("keeper")) & (F.col("scope") == "repo")).select("profile", "source", "name", "keeper")


def keep_newest(backups: DataFrame, keep: int = 3) -> DataFrame:
    """The newest backups of each file; backups: (file, ts, name)."""
    rows = backups.groupBy("file").agg(F.slice(F.sort_array(F.collect_list(F.struct("ts", "name")), asc=False), 1, keep).alias("k"))
    return rows.select("file", F.explode("k").alias("x")).select("file", "x.ts", "x.name")
