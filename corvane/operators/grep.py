"""Exact and regular-expression search, behind a trigram index where there is one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import CorvaneError, query_text
from ..functions import text as X

#: Hits of a file that are shown, and lines around a hit; beyond NATIVE hits of a file a literal is looked for by a worker.
PER_FILE, BEFORE, AFTER, NATIVE = 5, 2, 3, 50


def postings(files: DataFrame) -> DataFrame:
    """``trigram, content_hash``: equal contents are indexed once and found under each of their paths."""
    one = files.filter(F.col("content").isNotNull()).select(X.content_hash(F.col("content")).alias("content_hash"), "content").dropDuplicates(["content_hash"])
    return one.select(F.explode(X.trigrams(F.col("content"))).alias("trigram"), "content_hash")


def grams(literals: list[str]) -> list[str]:
    return sorted({s[i : i + 3] for s in literals for i in range(len(s) - 2)})


def candidates(posting: DataFrame, wanted: list[str], key: str = "content_hash") -> DataFrame:
    """The keys whose postings hold all of ``wanted``: one pass and one shuffle of a number per key, whose
    bits stand for up to 60 trigrams; further trigrams narrow what the first ones left."""
    first, rest = wanted[:60], wanted[60:]
    bits = F.create_map(*(F.lit(x) for i, g in enumerate(first) for x in (g, 1 << i)))
    held = posting.filter(F.col("trigram").isin(*first) & F.col(key).isNotNull())
    every = held.groupBy(key).agg(F.bit_or(bits[F.col("trigram")]).alias("m")).filter(F.col("m") == (1 << len(first)) - 1).select(key)
    return every.join(candidates(posting, rest, key), key, "left_semi") if rest else every


def narrowed(files: DataFrame, posting: DataFrame | None, literals: list[str], unfiltered: int | None = None) -> DataFrame:
    """The files that may hold ``literals``: by their trigrams, else by looking into each. Where no trigram narrows, all
    files, or the first ``unfiltered`` by path."""
    wanted = grams(literals)
    if not wanted and unfiltered is not None:
        return files.orderBy("path").limit(unfiltered)
    if wanted and posting is not None:
        return files.withColumn("content_hash", X.content_hash(F.col("content"))).join(candidates(posting, wanted), "content_hash", "left_semi").drop("content_hash")
    for s in literals:
        files = files.filter(F.contains("content", F.lit(s)))
    return files


def _positions(content: Column, literal: str, per_file: int = PER_FILE) -> Column:
    """Of the first ``per_file`` occurrences, overlapping ones too, the line; by one split before each of them."""
    q = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)
    parts = F.split(content, f"(?={q})", per_file + 2)
    first = F.startswith(content, F.lit(literal))
    # what stands before an occurrence: every part but the last, and nothing at the very beginning
    start = F.struct(F.lit(1).alias("line"), F.when(first, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("hits"))

    def step(a: Column, part: Column) -> Column:
        line = (a["line"] + F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))).cast("int")
        return F.struct(line.alias("line"), F.concat(a["hits"], F.array(line)).alias("hits"))

    walked = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["hits"]
    return F.slice(walked, 1, per_file)


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return (rows.orderBy("file", "n").limit(limit) if limit is not None else rows).drop("n")


def _scanned(found: DataFrame, pattern: str, per_file: int | None, group: int = 0) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern, re.M)
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines, line, at = None, 0, 0
                for n, m in enumerate(compiled.finditer(text)):
                    if n == per_file:
                        break
                    lines = text.split("\n") if lines is None else lines
                    line, at = line + text.count("\n", at, m.start()), m.start()
                    rows.append((path, line + 1, m[group], "\n".join(lines[max(0, line - BEFORE) : line + AFTER + 1]), n))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()))], ["file", "line", "match", "context", "n"])

    return found.filter(F.col("content").isNotNull()).select("path", "content").mapInArrow(scan, "file string, line int, match string, context string, n int")


def grep_literal(files: DataFrame, literal: str, limit: int | None = 20, posting: DataFrame | None = None, *, per_file: int | None = PER_FILE, unfiltered: int | None = None) -> DataFrame:
    """``file, line, match, context`` of the first ``per_file`` occurrences in each file (null: all), files in order of their path;
    of all files, or of the first ``unfiltered`` where no trigram narrows the search."""
    query_text(literal)
    found = narrowed(files, posting, [literal], unfiltered).filter(F.contains("content", F.lit(literal)))
    if per_file is None or per_file > NATIVE:
        return _first(_scanned(found, f"(?=({re.escape(literal)}))", per_file, 1), limit)
    hits = found.select("path", "content", F.posexplode(_positions(F.col("content"), literal, per_file)).alias("n", "line"))
    return _first(hits.select(F.col("path").alias("file"), "line", F.lit(literal).alias("match"), X.context_of(F.col("content"), F.col("line"), BEFORE, AFTER).alias("context"), "n"), limit)


def grep_regex(files: DataFrame, pattern: str, limit: int | None = 20, posting: DataFrame | None = None, *, per_file: int | None = PER_FILE, unfiltered: int | None = None) -> DataFrame:
    """As ``grep_literal``, for a Python regular expression in multi-line mode; literals in it narrow the search."""
    query_text(pattern)
    try:
        re.compile(pattern, re.M)
    except re.error as e:
        raise CorvaneError("INVALID_QUERY", f"not a regular expression: {e}") from e
    return _first(_scanned(narrowed(files, posting, X.regex_literals(pattern), unfiltered), pattern, per_file), limit)


def stats(files: DataFrame, posting: DataFrame) -> DataFrame:
    """One row: files and distinct trigrams."""
    n = posting.filter(F.col("trigram").isNotNull()).select("trigram").distinct().agg(F.count("*").alias("trigrams"))
    return files.select("path").distinct().agg(F.count("*").alias("files")).withColumn("_", F.lit(1)).join(n.withColumn("_", F.lit(1)), "_").drop("_")


def ranked(hits: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= most).drop("_n")
