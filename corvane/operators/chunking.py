"""Texts to line-addressed chunks: a native fold over lines, and definitions where these can be told."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from . import braces

#: Characters from which a chunk is closed, and without which, stripped, it is left out.
MOST, LEAST = 800, 50
#: Lines repeated from the neighbours, and characters of their previews.
OVERLAP, PREVIEW = 5, 500
#: Imports, exports and signatures in a summary, and its characters.
IMPORTS, EXPORTS, SIGNATURES, SUMMARY = 20, 10, 30, 2000
COMMENT = {"python": "#", "bash": "#", "ruby": "#", "yaml": "#", "toml": "#"}

_RANGE = "array<struct<begin: int, end: int>>"
_RANGES = f"struct<at: int, begin: int, size: int, done: array<{_RANGE}>, part: {_RANGE}>"
#: Ranges gathered before they are put with the others, which are copied as often as that happens.
_PART = 64


def fold(text: Column) -> Column:
    """Ranges of lines: a chunk closes with the line that brings it, line ends counted, to MOST characters."""
    lines = F.split(text, "\n", -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(1).alias("begin"), F.lit(0).alias("size"), F.array().cast(f"array<{_RANGE}>").alias("done"), F.array().cast(_RANGE).alias("part"))

    def step(a: Column, line: Column) -> Column:
        at, size = a["at"] + 1, a["size"] + F.length(line) + 1
        full = size >= MOST
        grown = F.concat(a["part"], F.array(F.struct(a["begin"].alias("begin"), at.alias("end"))))
        moved = full & (F.size(a["part"]) >= _PART)
        part = F.when(moved, F.slice(grown, -1, 1)).when(full, grown).otherwise(a["part"])
        done = F.when(moved, F.concat(a["done"], F.array(a["part"]))).otherwise(a["done"])
        return F.struct(at.alias("at"), F.when(full, at + 1).otherwise(a["begin"]).alias("begin"), F.when(full, 0).otherwise(size).alias("size"), done.alias("done"), part.alias("part"))

    def rest(a: Column) -> Column:
        every = F.concat(F.flatten(a["done"]), a["part"])
        return F.when(a["begin"] <= a["at"], F.concat(every, F.array(F.struct(a["begin"].alias("begin"), a["at"].alias("end"))))).otherwise(every)

    return F.aggregate(lines, zero.cast(_RANGES), lambda a, x: step(a, x).cast(_RANGES), rest)


def chunk_lines(files: DataFrame, path: str = "path", content: str = "content", *more: str) -> DataFrame:
    """``path, content, start_line, end_line`` of every chunk of LEAST stripped characters; texts of white
    space only and null texts have none. A line over MOST characters is one chunk; a shorter rest is left out."""
    filled = files.filter(F.length(X.stripped(F.col(content))) > 0)
    ranges = filled.select(path, *more, F.split(content, "\n", -1).alias("lines"), F.explode(fold(F.col(content))).alias("r"))
    body = F.array_join(F.slice("lines", F.col("r.begin"), F.col("r.end") - F.col("r.begin") + 1), "\n")
    return ranges.select(path, *more, body.alias("content"), F.col("r.begin").alias("start_line"), F.col("r.end").alias("end_line")).filter(F.length(X.stripped(F.col("content"))) >= LEAST)


DEFINED = "path string, content string, start_line int, end_line int, type string, name string, context array<string>, is_anchor boolean"


def _python(path: str, text: str) -> tuple[list[tuple], list[str], list[str], list[str]] | None:
    """Definitions (start, end, kind, name), imports, exports and signatures."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            found.append((start, node.end_lineno, "class" if isinstance(node, ast.ClassDef) else "function", node.name))
    imports = [ast.unparse(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    return found, imports, [], [s for s, _ in outline(text) or []]


def _braced(path: str, text: str) -> tuple[list[tuple], list[str], list[str], list[str]]:
    family = braces.FAMILIES[path.rpartition(".")[2].lower()]
    found, lines = braces.definitions(text, family), text.split("\n")
    imports, exports = braces.imports(text, family)
    return [d[:4] for d in found], imports, exports, [lines[d.start - 1].strip().rstrip("{ ") for d in found]


def _definitions(path: str, text: str) -> list[tuple] | None:
    """Outermost definitions, the gaps between them and a summary; None where none is found."""
    parsed = (_python if path.rpartition(".")[2].lower() in ("py", "pyw", "pyi") else _braced)(path, text)
    if parsed is None or not parsed[0]:
        return None
    found, imports, exports, signatures = parsed
    lines, rows = text.split("\n"), []
    for start, end, kind, name in found:
        body = "\n".join(lines[start - 1 : end])
        if len(body) >= LEAST:
            rows.append((path, body, start, end, kind, name, [f"File: {path}", f"{kind.capitalize()}: {name}"], False))
    if not rows:
        return None
    at = 1
    for a, b in [*sorted(f[:2] for f in found), (len(lines) + 1, 0)]:
        while at < a and not lines[at - 1].strip():
            at += 1
        end = a - 1
        while end >= at and not lines[end - 1].strip():
            end -= 1
        body = "\n".join(lines[at - 1 : end])
        if at <= end and len(body.strip()) >= LEAST:
            rows.append((path, body, at, end, "block", "", [f"File: {path}"], False))
        at = max(at, b + 1)
    rows = [piece for row in rows for piece in _split(row)]
    shown = [*imports[:IMPORTS], *exports[:EXPORTS], *signatures[:SIGNATURES]]
    if shown:
        mark = "#" if path.endswith((".py", ".pyw", ".pyi", ".rb", ".sh", ".bash", ".zsh")) else "//"
        rows.append((path, "\n".join(f"{mark} {x}" for x in shown)[:SUMMARY], 1, 1, "anchor", "", [f"File: {path}"], True))
    return sorted(rows, key=lambda r: (not r[7], r[2]))


def _split(row: tuple) -> Iterator[tuple]:
    """A chunk over MOST characters in parts, cut from four fifths of that where a block ends, else when full."""
    path, body, start, _, kind, name, context, anchor = row
    if len(body) <= MOST:
        yield row
        return
    lines, part, size, begin, n = body.split("\n"), [], 0, start, 1
    for i, line in enumerate(lines):
        part.append(line)
        size += len(line) + 1
        after = lines[i + 1] if i + 1 < len(lines) else ""
        ended = not line.strip() or bool(after) and not after[0].isspace()
        if i + 1 == len(lines) or size >= MOST or size >= MOST * 4 // 5 and ended:
            if len("\n".join(part).strip()) >= LEAST:
                yield (path, "\n".join(part), begin, start + i, kind, name, [*context, f"Part: {n}"], anchor)
                n += 1
            part, size, begin = [], 0, start + i + 1


def outline(text: str) -> list[tuple[str, int]] | None:
    """Signatures and their depth."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found = []

    def walk(nodes: list[ast.stmt], depth: int) -> None:
        for n in nodes:
            if isinstance(n, ast.ClassDef):
                bases = ", ".join([*map(ast.unparse, n.bases), *(f"{k.arg}={ast.unparse(k.value)}" for k in n.keywords if k.arg)])
                found.append((f"class {n.name}{f'({bases})' if bases else ''}:", depth))
                walk(n.body, depth + 1)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                word = "async def" if isinstance(n, ast.AsyncFunctionDef) else "def"
                found.append((f"{word} {n.name}({ast.unparse(n.args)}){f' -> {ast.unparse(n.returns)}' if n.returns else ''}:", depth))
    walk(tree.body, 0)
    return found


def chunk_definitions(files: DataFrame) -> DataFrame:
    """Chunks by definition for Python (by its syntax tree) and languages with braces, by lines for all
    others and for files in which no definition is found."""
    python = X.extension(F.col("path")).isin("py", "pyw", "pyi", *braces.FAMILIES)
    filled = files.filter(F.length(X.stripped(F.col("content"))) > 0).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += _definitions(path, text) or [(path, text, None, None, None, None, None, None)]
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "content", "start_line", "end_line", "type", "name", "context", "is_anchor"])

    parsed = filled.filter(python).mapInArrow(parse, DEFINED)
    rest = filled.filter(~python | python.isNull()).unionByName(parsed.filter(F.col("type").isNull()).select("path", "content"))
    plain = chunk_lines(rest).withColumns({"type": F.lit("block"), "name": F.lit(""), "context": F.array(F.concat(F.lit("File: "), "path")), "is_anchor": F.lit(False)})
    return parsed.filter(F.col("type").isNotNull()).unionByName(plain)


def neighbours(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with OVERLAP lines of the ones before and after, and with their previews; a summary takes no part."""
    w = Window.partitionBy("path").orderBy(F.col("is_anchor").desc(), "start_line")
    body = F.when(~F.col("is_anchor"), F.struct("start_line", "end_line", "content"))
    placed = chunks.withColumns({"before": F.lag(body).over(w), "after": F.lead(body).over(w)}).join(files.select("path", F.split("content", "\n", -1).alias("lines")), "path")
    mark = F.when(X.language(F.col("path")).isin(*COMMENT), "#").otherwise("//")
    since = F.greatest(F.col("before.end_line") - OVERLAP, F.lit(0))
    head = F.when(F.col("before").isNotNull(), F.concat(F.format_string("%s ... (context from lines %d-%d)\n", mark, since + 1, F.col("before.end_line")), F.array_join(F.slice("lines", since + 1, F.col("before.end_line") - since), "\n")))
    until = F.least(F.size("lines"), F.col("after.start_line") - 1 + OVERLAP)
    tail = F.when(F.col("after").isNotNull(), F.concat(F.array_join(F.slice("lines", F.col("after.start_line"), until - F.col("after.start_line") + 1), "\n"), F.format_string("\n%s ... (continues at line %d)", mark, until + 1)))
    full = F.when(F.col("is_anchor"), F.col("content")).otherwise(F.concat_ws("\n\n", head, "content", tail))
    previews = {"context_prev": F.substring(F.col("before.content"), -PREVIEW, PREVIEW), "context_next": F.substring(F.col("after.content"), 1, PREVIEW)}
    return placed.withColumns({**previews, "content": full}).drop("before", "after", "lines")


def indexed(chunks: DataFrame, modified: Column | None = None) -> DataFrame:
    """As stored: with an id, a name that is never null, and the file's time."""
    name = F.coalesce("name", F.lit("")) if "name" in chunks.columns else F.lit("")
    kind = F.col("type") if "type" in chunks.columns else F.lit("block")
    rows = chunks.select(X.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"), F.col("path").alias("file_path"), "content", "start_line", "end_line", name.alias("name"), kind.alias("node_type"), (modified if modified is not None else F.lit(None).cast("double")).alias("last_modified"))
    # a summary and a definition on line 1 would share an id
    return rows.withColumn("id", F.when(F.col("node_type") == "anchor", F.md5(F.concat("id", F.lit(":anchor")))).otherwise(F.col("id"))).dropDuplicates(["id"])
