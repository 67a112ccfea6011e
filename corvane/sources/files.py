"""Source files and settings as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut, partitions

# What is no source, as globs relative to the root, and folders a map leaves out.
EXCLUDED = (
    ".git/** .svn/** .hg/** node_modules/** .venv/** venv/** vendor/** dist/** build/** target/** __pycache__/** *.pyc *.pyo .idea/** .vscode/** *.swp *.swo "
    ".next/** .turbo/** coverage/** package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock poetry.lock Pipfile.lock *.min.js *.min.css"
).split()
SKIPPED = ".git .svn .hg node_modules .venv venv vendor __pycache__ dist build target .next .turbo .idea .vscode coverage".split()
MAX_SIZE, SNIFFED = 1 << 20, 8192


def glob_regex(glob: str) -> str:
    """A glob as git has it: with a slash inside it is anchored at the root, else it fits at any depth."""
    anchored = "/" in glob.rstrip("/")
    out = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|\*|\?|[^*?]+", glob))
    return ("^" if anchored else "(?:^|/)") + out + ("$" if anchored else "(?:$|/)")


def excluded(path: Column, globs: list[str] | tuple[str, ...] = tuple(EXCLUDED)) -> Column:
    return path.rlike("|".join(map(glob_regex, globs)))


def sized(length: Column, most: int = MAX_SIZE) -> Column:
    return (length > 0) & (length <= most)


def is_text(content: Column) -> Column:
    """No zero byte among the first bytes of a binary column."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, SNIFFED)) == 0


#: Entries that a task lists of the folders below before it leaves the rest to others; bytes of contents in a batch.
LISTED, BATCH = 5_000, 32 << 20
_ENTRY = "path string, folder boolean, mtime double, length bigint"


def _uri(root: str) -> str:
    return root if re.match(r"[a-z][a-z0-9+.-]*:", root) else "file://" + os.path.abspath(root)


def listing(spark: SparkSession, root: str, globs: tuple[str, ...] = tuple(EXCLUDED)) -> DataFrame:
    """``path, mtime, length`` of all files below ``root``, hidden ones too, by paths relative to it.

    Folders are listed by the workers: each goes down from the folders it is given until it has met LISTED entries, and what is
    left goes to all workers again. Folders that ``globs`` exclude as a whole aren't entered; links to folders aren't followed.
    """
    uri, closed = _uri(root), frozenset(g.removesuffix("/**") for g in globs if g.endswith("/**"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        base = base.rstrip("/")
        for b in batches:
            todo, out = b.column(0).to_pylist(), []
            while todo and len(out) < LISTED:
                at = todo.pop()
                for e in system.get_file_info(fs.FileSelector(f"{base}/{at}".rstrip("/") or "/", allow_not_found=True)):
                    inside = e.path[len(base) :].lstrip("/")
                    if e.type == fs.FileType.File:
                        out.append((inside, False, e.mtime_ns / 1e9 if e.mtime_ns is not None else None, e.size))
                    elif e.type == fs.FileType.Directory and inside not in closed and not (uri.startswith("file:") and os.path.islink(e.path)):
                        todo.append(inside)
            out += [(at, True, None, None) for at in todo]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.float64(), pa.int64()))], ["path", "folder", "mtime", "length"])

    found, todo = None, spark.createDataFrame([("",)], "path string")
    while True:
        level = cut(todo.repartition(partitions(spark)).mapInArrow(walk, _ENTRY))
        files = level.filter("not folder").select("path", "mtime", "length")
        found = files if found is None else found.unionByName(files)
        todo = level.filter("folder").select("path")
        if todo.isEmpty():
            return found


def source_files(spark: SparkSession, root: str, *, sizes: bool = True, most: int = MAX_SIZE, globs: tuple[str, ...] = tuple(EXCLUDED)) -> DataFrame:
    """``path, mtime, length`` of the files below ``root`` that may be source: by ``globs`` and by size, up to ``most`` bytes (any without ``sizes``)."""
    listed = listing(spark, root, globs).filter(~excluded(F.col("path"), globs))
    return listed.filter(sized(F.col("length"), most)) if sizes else listed


def read_tree(spark: SparkSession, root: str, **how) -> DataFrame:
    """``path, mtime, length, content`` of the text files among ``source_files``; files left out are never opened."""
    return read_files(source_files(spark, root, **how), root)


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """The text files among ``listed`` with their contents, read in parallel."""
    uri, listed = _uri(root), listed.select("path", "mtime", "length").repartition(partitions(listed.sparkSession))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        for b in batches:
            rows, held = [], 0
            for path, mtime, length in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        rows.append((path, mtime, length, f.read()))
                except OSError:  # gone since it was listed, or not to be read
                    continue
                held += length or 0
                if held >= BATCH:
                    yield _contents(rows)
                    rows, held = [], 0
            yield _contents(rows)

    raw = listed.mapInArrow(read, "path string, mtime double, length bigint, content binary")
    return raw.filter(is_text(F.col("content"))).select("path", "mtime", "length", X.valid_text(F.col("content")).alias("content"))


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.binary()))], ["path", "mtime", "length", "content"])


def aliases(settings: DataFrame, content: str = "content") -> DataFrame:
    """``prefix, target, ord`` of the path aliases in JSON settings with comments (tsconfig, jsconfig)."""
    # strings are kept whole, so that neither a URL nor a glob in them begins a comment
    plain = F.regexp_replace(content, r'(?s)("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', "$1")
    parsed = settings.select(F.from_json(plain, "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>").alias("j")).select("j.compilerOptions.*")
    one = parsed.select(F.coalesce("baseUrl", F.lit(".")).alias("base"), F.posexplode(F.map_entries("paths")).alias("ord", "e"))
    flat = one.select("base", "ord", F.regexp_replace("e.key", r"\*", "").alias("prefix"), F.explode("e.value").alias("target"))
    joined = F.concat_ws("/", "base", F.regexp_replace("target", r"\*", ""))
    return flat.select("prefix", F.regexp_replace(F.regexp_replace(joined, r"(^|/)(\./|\.$)", "$1"), "/+", "/").alias("target"), "ord")


def tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path, parent, name, depth, is_file``: each file and each of its folders once; hidden and skipped ones not."""
    parts = F.split(path, "/")
    shown = paths.select(parts.alias("p")).filter(~F.exists("p", lambda x: F.startswith(x, F.lit(".")) | (x == "")))
    shown = shown.filter(~F.exists(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x.isin(SKIPPED)))
    n = F.size("p")
    each = shown.select("p", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("depth"))
    at = F.slice("p", F.lit(1), F.col("depth"))
    row = each.select(F.array_join(at, "/").alias("path"), F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/").alias("parent"), F.element_at("p", F.col("depth")).alias("name"), "depth", (F.col("depth") == F.col("n")).alias("is_file"))
    return row.groupBy("path", "parent", "name", "depth").agg(F.max("is_file").alias("is_file"))
