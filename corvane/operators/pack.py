"""Ranked results under limits: coverage, paging, counts, token budgets, and merging of neighbouring chunks.

Ranked results are as many as were asked for, so what runs here over the whole ranking is small by
construction; the same functions take any DataFrame with a key to rank within.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import token_limit
from ..functions import text as X

#: Lines between chunks of a file that are still merged, fetched per result wanted, and the tiers of an audit.
GAP, FETCHED, LEAN, LARGE = 5, 3, 8_000, 15_000


def covered(ranked: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Without results from files that are taken whole."""
    return ranked.join(files.select(path).distinct(), path, "left_anti")


def page(ranked: DataFrame, limit: int, offset: int = 0, min_score: float | None = None) -> DataFrame:
    """Offset first, then the threshold, which doesn't end the list."""
    rows = ranked.filter(F.col("rank") > offset)
    return rows.filter(F.col("score") >= min_score) if min_score is not None else rows


def ordered(*by: str, keys: tuple[str, ...] = ()) -> Window:
    return Window.partitionBy(*keys).orderBy(*by) if keys else Window.partitionBy(F.lit(0)).orderBy(*by)


def chunk_budget(ranked: DataFrame, cost: Column, limit: int | None, used: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Up to, not including, the first row that brings the total over ``limit``; even the first may be that one."""
    w = ordered("rank", keys=keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.withColumn("cost", cost).withColumn("total", F.sum("cost").over(w) + used)
    return rows if token_limit(limit) is None else rows.filter(F.col("total") <= limit)


def file_budget(ranked: DataFrame, cost: Column, limit: int | None, used: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """While the total before a row is under ``limit``; the first always, and the last may go over."""
    w = ordered("rank", keys=keys)
    before = F.coalesce(F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + used
    rows = ranked.withColumn("cost", cost).withColumn("before", before)
    rows = rows.withColumn("total", F.col("before") + F.col("cost"))
    first = F.row_number().over(w) == 1
    return (rows if token_limit(limit) is None else rows.withColumn("_f", first).filter(F.col("_f") | (F.col("before") < limit)).drop("_f")).drop("before")


def at_most(ranked: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return ranked.withColumn("_n", F.row_number().over(ordered("rank", keys=keys))).filter(F.col("_n") <= n).drop("_n")


def islands(ranges: DataFrame, path: str = "path", start: str = "start_line", end: str = "end_line", gap: int = GAP) -> DataFrame:
    """``ranges`` with the number of the merged range, within its path, that each belongs to."""
    w = Window.partitionBy(path).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= reach + gap, 0).otherwise(1)
    return ranges.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge(chunks: DataFrame, files: DataFrame | None = None, gap: int = GAP) -> DataFrame:
    """Chunks of a file at most ``gap`` lines apart as one: first name and reason, best score, text from the file."""
    first = F.struct("start_line", "end_line", "rank")
    merged = islands(chunks, gap=gap).groupBy("path", "island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score"), F.min_by("name", first).alias("name"), F.min_by("reason", first).alias("reason"),
        F.count("*").alias("parts"), F.min_by("content", first).alias("content"),
    )
    if files is None:
        return merged.drop("island", "content")
    lines = files.select("path", F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n", -1).alias("lines"))
    body = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return merged.join(lines, "path", "left").withColumn("content", F.when(F.col("parts") == 1, F.col("content")).otherwise(F.coalesce(body, "content"))).drop("island", "lines")


def summary(packed: DataFrame, available: int, limit: int, offset: int, reason: str | None, max_tokens: int | None = None, unit: str = "chunks") -> DataFrame:
    """One row of totals, truncation and paging; ``packed`` has ``lines, chars, tokens``."""
    n = F.count("*")
    again = {"token_budget": f"Use a limit of {(max_tokens or 4000) * 2} tokens for more results", f"max_{unit}": f"Use a limit of {limit * 2} {unit} for more results"}.get(reason or "")
    row = packed.agg(n.alias("returned"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("lines", "chars", "tokens")))
    more = F.lit(offset) + F.col("returned") < available
    return row.withColumns({
        "truncated": F.lit(reason is not None), "total_available": F.lit(available), "reason": F.lit(reason).cast("string"), "suggestion": F.lit(again).cast("string"), "offset": F.lit(offset), "limit": F.lit(limit),
        "has_more": more, "next_offset": F.when(more, F.lit(offset + limit)),
    })


def audit(files: DataFrame, content: str = "content", keys: tuple[str, ...] = (), count: Callable[[str], int] | None = None) -> DataFrame:
    """``keys, path, tokens, lines, total, advice``: files by what they cost, and what the whole, of each of ``keys``, calls for."""
    rows = files.select(*keys, "path", X.token_count(F.col(content), count).alias("tokens"), F.size(F.split(F.regexp_replace(content, r"\r?\n\z", ""), "\n", -1)).alias("lines"))
    by = keys or ("_all",)
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    whole = rows.join(rows.groupBy(*by).agg(F.sum("tokens").alias("total")), list(by))
    advice = F.when(F.col("total") > LARGE, "use skeletons").when(F.col("total") > LEAN, "consider skeletons").otherwise("take it whole")
    return whole.withColumn("advice", advice).drop("_all")
