"""The engine as one object: index a tree, check names, condense outputs, report.

Tables live below one folder that all executors see.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.functions import text as T
from symbolith.operators import analytics, check, condense, delta, diff, extract, references, registry, report
from symbolith.session import materialize
from symbolith.sources import files as S
from symbolith.sources import tables, tree_stream
from symbolith.streaming import watch as W

CONDENSING = "command string, category string, original_tokens long, compressed_tokens long, saved long, seq long"
EVENTS = "symbol string, file string, type string, ts timestamp, session long, seq long"


class Engine:
    TOOLS = ("reindex", "refresh", "check", "references", "condense", "overview", "skeleton", "event_report", "clear_events", "notes", "watchlist",
             "autofix", "agent_notes", "prompt", "condensing_report", "reset_condensing", "check_report", "watch", "watch_health", "blocked", "setup")

    def __init__(self, spark: SparkSession, home: str, as_of: str, disabled: Iterable[str] = (), nested: bool = True, parsers: tuple[str, ...] = ()):
        unknown = set(disabled) - set(self.TOOLS)
        if unknown:
            raise ValueError(f"no such tools: {sorted(unknown)}")
        self.spark, self.home, self.as_of, self.disabled = spark, home.rstrip("/"), as_of, frozenset(disabled)
        self.extraction = {"nested": nested, "parsers": parsers}
        self._watchers: dict[str, W.Watcher] = {}

    def call(self, tool: str, *args, **options):
        """A tool by name; disabled ones are refused."""
        if tool not in self.TOOLS or tool in self.disabled:
            raise ValueError(f"tool {tool!r} is not available")
        return getattr(self, tool)(*args, **options)

    def _path(self, name: str) -> str:
        return f"{self.home}/{name}"

    def _table(self, name: str) -> DataFrame:
        state, df = tables.read(self.spark, self._path(name))
        if state != "ok":
            raise LookupError(f"{name} is {state}: index the project first" if state == "missing" else f"{name} is corrupt: reindex the project")
        return df

    def _ignored(self, root: str) -> list[str]:
        """Plain directory entries of the root's .gitignore."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/.gitignore")  # Spark's readers leave hidden files out
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        with contextlib.closing(fs.open(path)) as stream:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        lines = self.spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, text string")
        return [r["dir"] for r in S.gitignore_dirs(lines).collect()]  # one file's own lines

    def _limits(self, root: str, config: str | None, limits: dict) -> dict:
        own = S.scan_config(self.spark, config) if config else {"skipDirs": [], "includeDirs": []}
        return limits | {
            "skip_dirs": (*limits.get("skip_dirs", ()), *own["skipDirs"], *self._ignored(root)),
            "include_dirs": (*limits.get("include_dirs", ()), *own["includeDirs"]),
        }

    def _by_file(self, files: DataFrame, changed: DataFrame | None) -> None:
        """Write what is kept by file for ``files``; with ``changed`` (file), only in the place of those."""
        lines = extract.source_lines(files)
        for name, rows, key in (
            ("files", files.select("path", "lang", "lines", "size", "modified"), "path"),
            ("exports", references.module_exports(files), "module"),
            ("all_routes", extract.routes(lines), "file"),
            ("all_pages", extract.pages(files.where("lang = 'html'")), "file"),
        ):
            if changed is None:
                tables.write(delta.with_bucket(rows, delta.BUCKETS, key), self._path(name), "bucket")
            else:
                delta.by_file(self.spark, self._path(name), changed, rows, key)

    def _routes(self) -> DataFrame:
        return registry.first_wins(self._table("all_routes").drop("bucket"), "route", "file", "line")

    def _pages(self) -> DataFrame:
        return registry.first_wins(self._table("all_pages").drop("bucket"), "page", "file")

    def reindex(self, root: str, full: bool = False, config: str | None = None, **limits) -> dict:
        """Scan a tree and bring the tables up to date.

        Directories that .gitignore or the configuration (skipDirs, includeDirs) name are heeded. Without ``full``, files that
        didn't change aren't parsed, and only buckets with names or paths that changed are written.
        """
        limits = self._limits(root, config, limits)
        scanned = S.scan(S.read_tree(self.spark, root), **limits)
        listing = materialize(scanned.select("path", "lang", "size", "mtime", "truncated", "depth_truncated"))  # reads no contents
        state, cache = ("missing", None) if full else tables.read(self.spark, self._path("cache"), ("path", "symbols", "version"))
        if cache is not None and tables.read(self.spark, self._path("contributions"))[0] == "ok":
            changes = materialize(S.compare(listing, cache))
            touched = self._refreshed(scanned, changes, cache)
            parsed = changes.where("change <> 'deleted'").count()
        else:
            scanned = materialize(scanned)
            defs = materialize(extract.definitions(scanned, **self.extraction))
            tables.write(delta.with_bucket(S.cache_of(scanned, defs), delta.BUCKETS, "path"), self._path("cache"), "bucket")
            delta.build(defs, self.home)
            self._by_file(scanned, None)
            touched, parsed = None, listing.count()
        flags = listing.agg(F.max("truncated"), F.max("depth_truncated"), F.count("*")).first()
        meta = registry.registry_meta(root, listing, self.as_of, bool(flags[0]), bool(flags[1]), limits.get("max_files", S.MAX_FILES), limits.get("max_depth", S.MAX_DEPTH))
        tables.write(meta, self._path("meta"))
        out = {"files": flags[2], "truncated": bool(flags[0]), "depth_truncated": bool(flags[1]), "cache_hits": flags[2] - parsed}
        return out if touched is None else out | {"names_touched": touched}

    def _refreshed(self, scanned: DataFrame, changes: DataFrame, cache: DataFrame) -> int:
        """Take back what changed and deleted files contributed, and put in what they contribute now; the names touched."""
        if changes.isEmpty():
            return 0
        now = scanned.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
        span = now.agg(F.min("mtime"), F.max("mtime")).first()  # from the listing alone: with it, other files aren't opened
        now = materialize(now.where(F.col("mtime").between(*map(F.lit, span))) if span[0] else now)
        defs = materialize(extract.definitions(now, **self.extraction))
        files = changes.select(F.col("path").alias("file"))
        old = cache.join(changes.select("path"), "path", "left_semi").select("path", F.explode("symbols").alias("s"))
        old = materialize(old.select("s.category", "s.name", F.col("path").alias("file"), "s.line", "s.pass"))
        touched = delta.update(self.spark, self.home, files, old, defs)
        delta.by_file(self.spark, self._path("cache"), files, S.cache_of(now, defs), "path")
        self._by_file(now, files)
        return touched

    def refresh(self, root: str, **limits) -> dict:
        return self.reindex(root, full=False, **limits)

    def watch(self, root: str, enable: bool = True, debounce_ms: int = 600, **limits) -> dict:
        """Keep the tables up to date with a tree until called with ``enable=False``."""
        own = self._watchers.get(root)
        if own is not None and (not enable or not own.health()["active"]):
            self._watchers.pop(root).stop()
            own = None
        if enable and own is None:
            at = f"{self._path('watch')}/{uuid.uuid4().hex}"
            own = W.Watcher(lambda flushes: self.refresh(root, **limits), at, debounce_ms)
            own.start(tree_stream.tree_changes(self.spark, root, f"{at}/snapshots", project=root))
            self._watchers[root] = own
        return self.watch_health(root)

    def watch_health(self, root: str) -> dict | None:
        own = self._watchers.get(root)
        return own.health() if own is not None else None

    def events(self) -> DataFrame:
        state, df = tables.read(self.spark, self._path("events"))
        return df if state == "ok" else self.spark.createDataFrame([], EVENTS)

    def watchlist(self) -> DataFrame:
        return analytics.watchlist(analytics.newest(self.events()))

    def check(self, names: list[str], record: bool = True) -> DataFrame:
        """Verdicts of names in their order, with how often each was reported before."""
        known = registry.lookup(self._table("registry"))
        asked = self.spark.createDataFrame(list(enumerate(names)), "ord int, q string")
        checked = materialize(check.annotate(check.verdicts(asked, known), self.watchlist()))
        if record:
            rows = check.events(checked, self.as_of, 0)
            tables.append_numbered(rows.select("symbol", "file", "type", "ts", "session"), self._path("events"))
        return checked.orderBy("ord")

    def check_report(self, names: list[str], verbose: bool = False, form: str = "text", record: bool = True) -> str:
        """Verdicts of names as sections of text, or as JSON (``form="json"``)."""
        if not names:
            raise ValueError("names to check are needed")
        known = self._table("registry").select("category", "name", "file", "line", "usages", "locations")
        places = known.select("category", F.col("name").alias("match"), "file", "line", "usages", F.size(F.coalesce("locations", F.array())).alias("places"))
        found = materialize(self.check(names, record).join(places, ["category", "match"], "left"))
        health = [h for root in self._watchers if (h := self.watch_health(root))]
        notes = self.notes()
        if form == "json":
            row = check.report_json(found, notes).first()
            return json.dumps(json.loads(row["report"]) | {"watchers": health})
        rows = check.report_lines(found, verbose).orderBy("section", "ord").select("text").collect()  # one line a queried name
        unknown = not found.where("verdict = 'unknown'").isEmpty()
        sick = [f"Watcher is unhealthy: {h['last_error'] or 'retry pending'}" for h in health if h["last_error"] or h["recovery_pending"]]
        return "\n".join([*(r["text"] for r in rows), *(notes if unknown else []), *sick])

    def notes(self) -> list[str]:
        """Why verdicts may be wrong: an old or an incomplete registry."""
        stale = T.staleness_note(F.col("scanned"), F.lit(self.as_of))
        row = self._table("meta").select(stale.alias("a"), T.incomplete_note(F.col("truncated"), F.col("depth_truncated")).alias("b")).first()
        return [x for x in row if x]

    def _ledger(self, files: DataFrame) -> DataFrame:
        """Names of this session, with those that ``files`` define; kept for the next call."""
        state, old = tables.read(self.spark, self._path("ledger"), ("name", "seq"))
        old = materialize(old) if state == "ok" else self.spark.createDataFrame([], "name string, seq long")
        now = materialize(references.session_names(old, files))
        tables.write(now, self._path("ledger"))
        return now

    def references(self, files: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
        """Findings in written files (path, content), lists capped at ten per kind.

        With ``diffs`` (diff), unified diffs that led to the files, only what added lines refer to is looked at.
        """
        noted = F.lower("path").endswith(".md")
        files = files.withColumn("content", F.when(noted, references.fences(F.col("content"))).otherwise(F.col("content")))  # of notes, their scripts
        scan = files
        if diffs is not None:
            scan = diff.added_content(files.where(~noted), diff.added(diffs)).unionByName(files.where(noted).select("path", "content"))
        reg = registry.lookup(self._table("registry")).select("name", "namespace", F.concat_ws("|", F.col("cat_rank"), "file", F.lpad(F.col("line").cast("string"), 9, "0")).alias("ord"))
        more = self._routes().select(F.col("route").alias("name")).unionByName(self._pages().select(F.col("page").alias("name")))
        names = references.name_report(files, reg, more, self._ledger(files), scan=scan)
        bad = references.bad_routes(references.route_literals(scan), self._routes().select("method", "path"))
        imports, listing = references.import_paths(scan), self._table("files")
        missing = references.missing_imports(imports, listing)
        hidden = references.not_exported(references.named_imports(scan), references.resolved(imports, listing), self._table("exports"))
        none = F.lit(None).cast("string").alias("detail")
        rows = names.unionByName(bad.select("path", F.col("literal").alias("name"), F.lit("route").alias("finding"), none))
        rows = rows.unionByName(missing.select("path", F.col("import_path").alias("name"), F.lit("import").alias("finding"), none))
        rows = rows.unionByName(hidden.select("path", "name", F.lit("not exported").alias("finding"), F.col("import_path").alias("detail")))
        return references.capped(rows, {"unknown": 10, "route": 10, "not exported": 10})

    def blocked(self, files: DataFrame, diffs: DataFrame | None = None) -> int:
        """Exit status of a check of written files: 2 if anything was found, else 0."""
        return 0 if self.references(files, diffs).isEmpty() else 2

    def autofix(self, files: DataFrame) -> DataFrame:
        """The files in which a typo was found, with it put right."""
        return references.autofix(files, materialize(self.references(files)))

    def _condensing(self) -> DataFrame:
        state, log = tables.read(self.spark, self._path("condensing"))
        return log if state == "ok" else self.spark.createDataFrame([], CONDENSING)

    def condense(self, outputs: DataFrame, command: str = "command", record: bool = True, **options) -> DataFrame:
        """Condensed outputs; what they saved is recorded."""
        out = condense.condense(outputs, command=command, **options)
        if not record:
            return out
        out = materialize(out)
        rows = out.select(F.col(command).alias("command"), "category", "condensed.original_tokens", "condensed.compressed_tokens")
        rows = analytics.condensing_log(rows)
        tables.append_numbered(rows.select("command", "category", "original_tokens", "compressed_tokens", "saved"), self._path("condensing"))
        return out

    def condensing_report(self) -> dict[str, DataFrame]:
        log = self._condensing()
        return {"totals": analytics.condensing_stats(log), "top": analytics.top_commands(log)}

    def reset_condensing(self) -> None:
        tables.clear(self.spark, self._path("condensing"))

    def agent_notes(self, existing: str = "") -> str:
        """``existing`` notes with the managed block of rules and facts put in or renewed."""
        reg = self._table("registry")
        block = report.managed_block(self.watchlist(), registry.category_counts(reg), reg.where("category = 'exports'"), self._routes())
        return tables.upsert_block(existing, block)

    def prompt(self, minimal: bool = False) -> str:
        """A reminder with the state of the registry and the names reported most."""
        state, reg = tables.read(self.spark, self._path("registry"))
        meta = {"symbols": reg.count() + self._routes().count() + self._pages().count(), "files": self._table("meta").first()["file_count"]} if state == "ok" else None
        return report.prompt(meta, self.watchlist(), minimal)

    def overview(self, max_files: int = 100) -> dict[str, DataFrame]:
        reg, files = self._table("registry"), self._table("files")
        return {
            "tree": report.tree(files, max_files),
            "counts": registry.category_counts(reg),
            "languages": registry.language_breakdown(files),
            "symbols": report.symbol_lists(reg),
            "routes": report.routes_by_file(self._routes()),
            "pages": report.page_list(self._pages()),
        }

    def skeleton(self, files: DataFrame) -> DataFrame:
        return extract.skeletons(files.withColumn("lang", extract.language(F.col("path"))))

    def setup(self, configs: DataFrame, profiles: DataFrame, backups: DataFrame | None = None) -> dict[str, DataFrame]:
        """What a set-up of tools would find: the servers of all configurations (source, kind, content) with those that a server of the same
        profile (profile, pattern) replaces, and the backups (file, ts, name) that stay."""
        servers = tables.server_entries(configs)
        scored = servers.select("source", "name", F.col("name").alias("command"), F.lit("repo").alias("scope"), F.char_length("name").alias("score"))
        out = {"servers": servers, "redundant": tables.redundant_servers(scored, profiles)}
        return out if backups is None else out | {"backups": tables.keep_newest(backups)}

    def event_report(self) -> DataFrame:
        return analytics.report(analytics.newest(self.events()))

    def clear_events(self) -> None:
        tables.clear(self.spark, self._path("events"))
