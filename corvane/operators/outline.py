"""Maps and skeletons: the shape of a repository and of its files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import braces
from .chunking import outline

#: Levels of indentation and characters of a signature that a map shows.
LEVELS, WIDTH = 2, 80
def signatures_of(path: str, text: str) -> list[tuple[str, int]]:
    ext = path.rpartition(".")[2].lower()
    if ext in ("py", "pyw", "pyi"):
        return outline(text) or []
    return braces.signatures(text, braces.FAMILIES[ext]) if ext in braces.FAMILIES else []


def signatures(files: DataFrame) -> DataFrame:
    """``path, sigs``: the signatures of each code file with their depth, in order."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("depth", pa.int32())]))
        for b in batches:
            found = [[{"text": s, "depth": d} for s, d in signatures_of(p, t)] for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["path", "sigs"])

    code = files.filter(X.extension(F.col("path")).isin("py", "pyw", "pyi", *braces.FAMILIES) & F.col("content").isNotNull())
    return code.select("path", "content").mapInArrow(read, "path string, sigs array<struct<text: string, depth: int>>")


def shown(sigs: DataFrame, most: int | None = None) -> DataFrame:
    """``path, at, line``: the first ``most`` signatures, cut to WIDTH and indented, and a note on the rest."""
    n = F.size("sigs")
    kept = F.slice("sigs", 1, most) if most is not None else F.col("sigs")
    lines = F.transform(kept, lambda s: F.concat(F.repeat(F.lit("    "), F.least(s["depth"], F.lit(LEVELS))), X.preview(s["text"], WIDTH)))
    if most is not None:
        lines = F.when(n > most, F.concat(lines, F.array(F.format_string("... (%d more)", n - most)))).otherwise(lines)
    return sigs.select("path", F.posexplode(lines).alias("at", "line"))


def skeleton(text: str, keep: frozenset[str] = frozenset(), lines: frozenset[int] = frozenset()) -> str:
    """A Python file with the bodies of its functions left out, but for those named or on ``lines``."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return text
    source = text.split("\n")
    cuts: list[tuple[int, int, str]] = []

    def walk(nodes: list[ast.stmt]) -> None:
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if n.name in keep or lines & set(range(n.lineno, n.end_lineno + 1)) or n.body[0].lineno == n.lineno:
                    continue
                first = n.body[0].lineno
                indent = re.match(r"\s*", source[first - 1])[0]
                cuts.append((first, n.end_lineno, indent + "..."))
            elif isinstance(n, ast.ClassDef):
                walk(n.body)
            else:
                for block in ("body", "orelse", "finalbody"):
                    walk(getattr(n, block, []) if isinstance(getattr(n, block, []), list) else [])

    walk(tree.body)
    for first, last, line in sorted(cuts, reverse=True):
        source[first - 1 : last] = [line]
    return "\n".join(source)


def skeleton_of(path: str, text: str, keep: frozenset[str] = frozenset(), lines: frozenset[int] = frozenset()) -> str:
    """The skeleton of a file whose language has one; other files unchanged."""
    ext = path.rpartition(".")[2].lower()
    if ext in ("py", "pyw", "pyi"):
        return skeleton(text, keep, lines)
    return braces.skeleton(text, braces.FAMILIES[ext], keep, lines) if ext in braces.FAMILIES else text


def skeletonize(files: DataFrame, keep: frozenset[str] = frozenset()) -> DataFrame:
    """``path, skeleton``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else skeleton_of(p, t, keep) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "skeleton"])

    return files.select("path", "content").mapInArrow(read, "path string, skeleton string")
