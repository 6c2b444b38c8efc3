"""A folder's changes as a stream: ``spark.readStream.format("tree_changes")``.

Offsets are numbers of listing snapshots. Each poll lists the folder; a listing that differs from the last is kept
as the next snapshot, in a state folder that all executors see, so the changes between two offsets are the same whenever
they are read, also after a restart, and a file that is gone is a change like others. A batch reads the snapshots in
``shards`` by path hash, and compares each with the one before.

Options: ``path``; ``state``, the folder of snapshots; ``project``, a name that rows carry; ``initial``: "true" makes the
files of the first listing changes too; ``shards`` (4); ``keep`` (16), snapshots that stay after they are committed.
The listing passes through the driver: a watcher is for a project's tree, whose skipped and hidden directories aren't entered.
"""

from __future__ import annotations

import datetime
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from symbolith.operators.rules import LANGUAGES
from symbolith.sources.files import ALWAYS_SKIP

FORMAT = "tree_changes"
MAX_DEPTH = 12
ROW = "project string, path string, change string, size long, mtime timestamp, ts timestamp"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def listing(uri: str, max_depth: int = MAX_DEPTH) -> dict[str, tuple[int, int]]:
    """(size, mtime in microseconds) of the code files below a folder; a folder that is gone has none."""
    fs, root = _open(uri.rstrip("/"))
    out, todo = {}, [(root, 0)]
    while todo:
        at, depth = todo.pop()
        for info in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            name = info.base_name
            if info.type == pafs.FileType.Directory:
                if depth < max_depth and not name.startswith(".") and name not in ALWAYS_SKIP:
                    todo.append((info.path, depth + 1))
            elif info.type == pafs.FileType.File and "." + info.extension in LANGUAGES:
                out[info.path[len(root) :].lstrip("/")] = (info.size, info.mtime_ns // 1000)
    return out


class Snapshots:
    """Numbered listings in a folder; one appears whole or not at all."""

    def __init__(self, uri: str):
        self.fs, self.root = _open(uri.rstrip("/"))
        self.fs.create_dir(self.root, recursive=True)

    def numbers(self) -> list[int]:
        infos = self.fs.get_file_info(pafs.FileSelector(self.root))
        return sorted(int(i.base_name[:-5]) for i in infos if i.base_name.endswith(".json") and i.base_name[:-5].isdigit())

    def read(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/{number}.json") as f:
            return json.loads(f.read())

    def write(self, number: int, files: dict[str, tuple[int, int]]) -> None:
        tmp = f"{self.root}/{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(tmp) as f:
            f.write(json.dumps({"ts": datetime.datetime.now(datetime.timezone.utc).timestamp(), "files": files}).encode())
        self.fs.move(tmp, f"{self.root}/{number}.json")

    def remove(self, number: int) -> None:
        self.fs.delete_file(f"{self.root}/{number}.json")


class Between(InputPartition):
    def __init__(self, start: int, end: int, shard: int):
        self.start, self.end, self.shard = start, end, shard


def differences(before: dict, after: dict) -> Iterator[tuple[str, str]]:
    """(path, change) of the files added, modified or deleted."""
    for path, own in after.items():
        if path not in before:
            yield path, "added"
        elif list(before[path]) != list(own):
            yield path, "modified"
    for path in before:
        if path not in after:
            yield path, "deleted"


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.state, self.project = options["path"], options["state"], options.get("project", "")
        self.first = options.get("initial", "false").lower() == "true"
        self.shards, self.keep = int(options.get("shards", 4)), int(options.get("keep", 16))

    def _snapshots(self) -> Snapshots:
        """The snapshots, of which the first is taken when the stream is first looked at."""
        snapshots = Snapshots(self.state)
        if not snapshots.numbers():
            snapshots.write(0, {} if self.first else listing(self.path))
        return snapshots

    def initialOffset(self) -> dict:
        return {"snapshot": self._snapshots().numbers()[0]}

    def latestOffset(self) -> dict:
        snapshots = self._snapshots()
        last = snapshots.numbers()[-1]
        now = listing(self.path)
        if next(differences(snapshots.read(last)["files"], now), None):
            last += 1
            snapshots.write(last, now)
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Between(start["snapshot"], end["snapshot"], k) for k in range(self.shards)] if start != end else []

    def read(self, partition: Between) -> Iterator[tuple]:
        snapshots, epoch = Snapshots(self.state), datetime.datetime(1970, 1, 1)
        mine = lambda files: {p: x for p, x in files.items() if zlib.crc32(p.encode()) % self.shards == partition.shard}
        before = mine(snapshots.read(partition.start)["files"])
        for number in range(partition.start + 1, partition.end + 1):
            after = snapshots.read(number)
            ts, files = epoch + datetime.timedelta(seconds=after["ts"]), mine(after["files"])
            for path, change in differences(before, files):
                size, mtime = files.get(path) or before[path]
                yield self.project, path, change, size, epoch + datetime.timedelta(microseconds=mtime), ts
            before = files

    def commit(self, end: dict) -> None:
        snapshots = Snapshots(self.state)
        for number in snapshots.numbers():
            if number < end["snapshot"] - self.keep:
                snapshots.remove(number)


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeReader(self.options)


def tree_changes(spark: SparkSession, path: str, state: str, **options):
    """The stream of changes below ``path``."""
    spark.dataSource.register(TreeChanges)
    reader = spark.readStream.format(FORMAT).option("state", state)
    return reader.options(**options).load(path)
