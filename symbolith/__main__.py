"""Command line of the engine: ``python -m symbolith HOME VERB ...``; exit status 0, 2 for wrong use or findings."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from symbolith.facade import Engine
from symbolith.session import local_session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m symbolith", description="Index a source tree, check names and written files against it, report.")
    out.add_argument("home", help="folder of the engine's tables")
    verbs = out.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str, *arguments: tuple[str, dict]) -> None:
        own = verbs.add_parser(name, help=text)
        for argument, options in arguments:
            own.add_argument(argument, **options)

    some = {"nargs": "+"}
    verb("index", "scan a tree and bring the tables up to date", ("root", {}), ("--full", {"action": "store_true"}), ("--config", {}))
    verb("check", "verdicts of names", ("names", some), ("--json", {"action": "store_true"}), ("--verbose", {"action": "store_true"}))
    verb("references", "findings in written files; status 2 if there are any", ("files", some), ("--diff", {"help": "unified diff that led to the files: only added lines are checked"}))
    verb("watch", "keep the tables up to date until stopped", ("root", {}), ("--debounce-ms", {"type": int, "default": 600}))
    verb("overview", "files, symbols, routes and pages")
    verb("report", "names reported most")
    verb("skeleton", "signatures of files", ("files", some))
    verb("agents", "notes with the managed block, printed or written to a file", ("file", {"nargs": "?"}))
    verb("prompt", "a reminder with the state of the registry", ("--minimal", {"action": "store_true"}))
    verb("setup", "servers of configuration files, and those that others replace", ("configs", some), ("--profile", {"action": "append", "default": [], "metavar": "NAME=PATTERN"}))
    return out


def _texts(paths: list[str]) -> list[tuple[str, str]]:
    return [(p, Path(p).read_text()) for p in paths]


def main(args: list[str]) -> int:
    try:
        o = parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    spark = local_session()
    engine = Engine(spark, o.home, datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
    files = lambda: spark.createDataFrame(_texts(o.files), "path string, content string")
    if o.verb == "index":
        print(engine.reindex(o.root, full=o.full, config=o.config))
    elif o.verb == "check":
        print(engine.check_report(o.names, o.verbose, "json" if o.json else "text"))
    elif o.verb == "references":
        found = engine.references(files(), spark.createDataFrame(_texts([o.diff]), "path string, diff string") if o.diff else None)
        rows = found.orderBy("path", "finding", "name").collect()  # capped for each file
        for r in rows:
            print(f"{r['path']}: {r['finding']}: {r['name']}" + (f" ({r['detail']})" if r["detail"] else ""), file=sys.stderr)
        return 2 if rows else 0
    elif o.verb == "watch":
        engine.watch(o.root, debounce_ms=o.debounce_ms)
        engine._watchers[o.root].query.awaitTermination()
    elif o.verb == "overview":
        for name, df in engine.overview().items():
            print(name)
            df.show(100, False)
    elif o.verb == "report":
        engine.event_report().show(20, False)
    elif o.verb == "skeleton":
        engine.skeleton(files()).show(1000, False)
    elif o.verb == "agents":
        at = Path(o.file) if o.file else None
        notes = engine.agent_notes(at.read_text() if at and at.exists() else "")
        at.write_text(notes) if at else print(notes)
    elif o.verb == "prompt":
        print(engine.prompt(o.minimal))
    elif o.verb == "setup":
        configs = [(p, "toml" if p.endswith(".toml") else "json", text) for p, text in _texts(o.configs)]
        profiles = spark.createDataFrame([tuple(x.split("=", 1)) for x in o.profile], "profile string, pattern string")
        for name, df in engine.setup(spark.createDataFrame(configs, "source string, kind string, content string"), profiles).items():
            print(name)
            df.orderBy(*df.columns).show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
