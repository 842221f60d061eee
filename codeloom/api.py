"""Commands: scan, view, export, annotate, snapshot, functions. `python -m codeloom.api COMMAND ...`."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from codeloom.functions import export as ex
from codeloom.operators import build as build_
from codeloom.operators.build import build
from codeloom.operators.resolve import resolve_asts
from codeloom.operators.subgraph import extract
from codeloom.schema import Graph
from codeloom.sources import files, store
from codeloom.streaming import watch as watching


def home(root: str) -> str:
    return os.path.join(root, ".codeloom")


def scan(spark: SparkSession, root: str, level: str = "file", options: files.ScanOptions = files.ScanOptions(), narrow: bool = False) -> Graph:
    """Bring the stored graph up to date and return it. narrow: keep imports only, as quick scans do, without the store."""
    root = os.path.abspath(root)
    if narrow:
        asts = files.compatible(files.scan(spark, root, options))
        return build(resolve_asts(asts.drop("content_hash", "hit")), level, root)
    return watching.rebuild(spark, root, os.path.join(home(root), "store"), level, options)


def stored(root: str, level: str = "function") -> watching.Maintained:
    return watching.Maintained(os.path.join(home(os.path.abspath(root)), "store", level), level)


def graph_of(spark: SparkSession, root: str, cached: bool = False) -> Graph:
    return (stored(root).current(spark) if cached else None) or scan(spark, root, "function")


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom")
    sub = parser.add_subparsers(dest="command")
    for name in ("scan", "view", "export", "snapshot", "annotate", "functions"):
        p = sub.add_parser(name)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--output")
        if name in ("scan", "view"):
            p.add_argument("--include", action="append", default=[])
            p.add_argument("--exclude", action="append", default=[])
            p.add_argument("--depth", type=int)
            p.add_argument("--level", choices=("file", "function"), default="function" if name == "view" else "file")
        if name == "scan":
            p.add_argument("--format", choices=("json", "dot"), default="json")
            for flag in ("--pretty", "--cycles", "--orphans", "--stats"):
                p.add_argument(flag, action="store_true")
        if name == "view":
            p.add_argument("--watch", action="store_true")
        if name == "export":
            p.add_argument("--from", dest="start", required=True)
            p.add_argument("--depth", type=int, default=2)
            p.add_argument("--direction", choices=("downstream", "upstream", "both"), default="both")
            p.add_argument("--format", choices=("json", "markdown"), default="markdown")
            p.add_argument("--max-nodes", type=int, default=200)
        if name == "snapshot":
            p.add_argument("--title", default="Dependency graph")
        if name in ("annotate", "functions"):
            p.add_argument("--file", required=name == "functions")
        if name == "annotate":
            for field in ("--team", "--domain", "--status"):
                p.add_argument(field)
            p.add_argument("--tag", action="append")
            p.add_argument("--remove", action="store_true")
            p.add_argument("--list", action="store_true")
    argv = sys.argv[1:] if argv is None else argv
    args = parser.parse_args(argv or ["view", "."])
    spark = SparkSession.builder.appName("codeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("scan", "view"):
        options = files.ScanOptions(include=tuple(args.include), exclude=tuple(args.exclude), depth=args.depth)
        graph = scan(spark, args.path, args.level, options)
        if args.command == "view":
            ex.write_text(ex.to_html(graph, os.path.abspath(args.path)), args.output or os.path.join(home(args.path), "view.html"))
            if args.watch:
                kept = stored(args.path, args.level)
                page = args.output or os.path.join(home(args.path), "view.html")
                kept.listeners.append(lambda _: ex.write_text(ex.to_html(kept.current(spark), os.path.abspath(args.path)), page))
                watching.watch(spark, os.path.abspath(args.path), kept, os.path.join(home(args.path), "checkpoint"), options=options).awaitTermination()
            return 0
        ex.write_text(ex.to_dot(graph) if args.format == "dot" else ex.to_json(graph, args.pretty), args.output)
        for line in ex.report(graph, args.cycles, args.orphans, args.stats):
            print(line, file=sys.stderr)
    elif args.command == "export":
        found = extract(graph_of(spark, args.path), args.start, args.depth, args.direction, args.max_nodes)
        ex.write_text((ex.to_ai_json if args.format == "json" else ex.to_ai_markdown)(found, now()), args.output)
    elif args.command == "functions":
        scan(spark, args.path, "function")
        found = build_.functions_by_file(stored(args.path).functions(spark, args.file))
        ex.write_text(json.dumps([r.asDict(recursive=True) for r in found.orderBy("name", "kind").collect()]), args.output)  # one file's
    elif args.command == "snapshot":
        ex.write_text(ex.to_html(graph_of(spark, args.path), args.title), args.output or "snapshot.html")
    else:
        path = os.path.join(home(args.path), "annotations.yaml")
        notes = store.load_annotations(spark, path)
        if args.remove:
            notes, there = store.remove_annotation(notes, args.file)
            print("removed" if there else "no such annotation")
            store.save_annotations(notes, path)
        elif args.list or not args.file:
            for r in store.list_annotations(notes).toLocalIterator():
                print(r["path"], r["line"])
        else:
            store.save_annotations(store.set_annotation(notes, args.file, args.team, args.domain, args.status, args.tag), path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
