"""``corvane COMMAND``, or ``python -m corvane.plans.cli COMMAND``: the engine's queries from a shell."""

from __future__ import annotations

import argparse
import os
import sys

from ..errors import CorvaneError
from ..session import local_session
from . import render, tools
from .engine import Engine

STORES = os.path.join(os.path.expanduser("~"), ".corvane", "index")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("--root", default=".")
    p.add_argument("--store", help="where the index lies; by default below the home folder, by root")
    c = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> argparse.ArgumentParser:
        q = c.add_parser(name)
        for x in positional:
            q.add_argument(x)
        for k, default in options.items():
            flag = "--" + k.replace("_", "-")
            if default is False:
                q.add_argument(flag, action="store_true")
            elif isinstance(default, type):
                q.add_argument(flag, type=default)
            elif isinstance(default, tuple):
                q.add_argument(flag, choices=default, default=default[0])
            else:
                q.add_argument(flag, type=type(default), default=default)
        return q

    def ranked(q: argparse.ArgumentParser) -> None:
        # there is one ranking; scripts that choose among several go on working
        for name in ("rerank", "hybrid"):
            q.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=True, help="accepted; there is one ranking")

    forms = ("xml", "compact")
    command("index", force=False)
    command("info")
    ranked(command("search", "query", limit=10, min_score=float))
    command("grep", "pattern", regex=False, limit=20, per_file=5)
    command("find", "query", max_results=5, format=forms)
    command("explain", "path", function=str, format=forms)
    command("discover", "path", format=forms)
    command("impact", "path", function=str, depth=3, format=forms)
    command("map", format=("tree", "flat"), no_signatures=False, max_sigs=10)
    command("probe", "file", limit=10)
    ranked(command("pack", focus=str, query=str, max_files=10, max_chunks=20, max_tokens=int, min_score=float, import_depth=2, offset=0, format=("xml", "compact", "chunks"), chunks=False, skeleton=False, focus_only=False, quiet=False, verbose=False))
    command("audit", focus=str, query=str, max_files=10, max_tokens=int, import_depth=2, skeleton=False)
    command("serve")
    command("watch", every="2 seconds")
    return p


def run(e: Engine, a: argparse.Namespace) -> str:
    rows = lambda df: [r.asDict() for r in df.collect()]
    match a.command:
        case "index":
            return render.attributes(**e.index(a.force))
        case "info":
            return render.attributes(**e.info())
        case "search":
            return render.table(rows(e.search(a.query, a.limit, a.min_score)), ["score", "file_path", "start_line", "end_line", "name"])
        case "grep":
            return render.grep(a.pattern, a.regex, rows(e.grep(a.pattern, a.regex, a.limit, a.per_file)))
        case "find":
            found, total = e.find(a.query, a.max_results)
            return render.find(a.query, rows(found), total, a.format)
        case "explain":
            return render.explain(e.explain(e.inside(a.path), a.function), a.format)
        case "discover":
            path = e.inside(a.path)
            return render.discovery(path, rows(e.discover(path).orderBy("depth", "path")), rows(e.related(path)), a.format)
        case "impact":
            path = e.inside(a.path)
            return render.impact(path, a.function, rows(e.impact(path, a.depth, function=a.function)), a.format)
        case "map":
            return e.map(a.format, not a.no_signatures, a.max_sigs)
        case "probe":
            with open(a.file, encoding="utf-8", errors="ignore") as f:
                return render.probe(e.probe(f.read(), a.limit))
        case "pack":
            found = e.pack(a.focus, a.query, max_files=a.max_files, max_chunks=a.max_chunks, max_tokens=a.max_tokens, min_score=a.min_score, import_depth=a.import_depth, offset=a.offset, chunk_mode=a.chunks or a.format == "chunks", skeleton=a.skeleton, focus_only=a.focus_only)
            return render.pack(found, a.format, quiet=a.quiet, verbose=a.verbose)
        case _:
            return render.audit(e.audit(focus=a.focus, query=a.query, max_files=a.max_files, max_tokens=a.max_tokens, import_depth=a.import_depth, skeleton=a.skeleton), a.skeleton)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        spark = local_session()
        if a.command == "serve":
            tools.serve(tools.Tools(spark, a.store or STORES), sys.stdin, sys.stdout)
            return 0
        store = a.store or os.path.join(STORES, tools.index_name(a.root))
        e = Engine.over(spark, os.path.abspath(a.root) if "://" not in a.root else a.root, store)
        if a.command == "watch":
            from ..streaming.watch import TreeWatcher

            TreeWatcher(spark, a.root, lambda: print(render.attributes(**Engine.over(spark, a.root, store).index())), store + "-watch").start(a.every).query.awaitTermination()
            return 0
        print(run(e, a))
    except CorvaneError as x:
        print(x.as_text(), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
