"""Incremental maintenance: what changed between two snapshots, and tables brought up to date with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(current: DataFrame, stored: DataFrame, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """``path, action, mtime``: add, modify (strictly newer only), remove or keep; one full outer join."""
    c = current.groupBy(path).agg(F.max(mtime).alias("new"))
    s = stored.groupBy(path).agg(F.max(mtime).alias("old"))
    joined = c.withColumn("here", F.lit(True)).join(s.withColumn("there", F.lit(True)), path, "full_outer")
    action = F.when(F.col("there").isNull(), "add").when(F.col("here").isNull(), "remove").when(F.col("new") > F.col("old"), "modify").otherwise("keep")
    return joined.select(path, action.alias("action"), F.coalesce("new", "old").alias("mtime"))


def touched(delta: DataFrame, *actions: str, path: str = "path") -> DataFrame:
    return delta.filter(F.col("action").isin(*actions)).select(path)


def apply(chunks: DataFrame, delta: DataFrame, fresh: DataFrame, path: str = "file_path") -> DataFrame:
    """Stored chunks without those of changed files, and the new ones; an id is kept once."""
    gone = touched(delta, "modify", "remove").withColumnRenamed("path", path)
    return chunks.join(gone, path, "left_anti").unionByName(fresh).dropDuplicates(["id"])


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` take the place of those of the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.dropDuplicates([key]))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")
