"""Problem 2: source files whose content the grammar of their language rejects.

Each content is parsed where it lies, by the parsers of ``syntax``; nothing but verdicts is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import syntax
from .hot import anonymous

VERDICT = "file_id bigint, repo string, language string, faults int, first_line int, first_cause string, all_faults array<struct<line: int, message: string>>, other bigint"
_FAULTS = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [syntax.faults(language, text) for language, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                *(b.column(i) for i in range(3)),
                pa.array([len(f) for f in found], pa.int32()),
                pa.array([f[0].line if f else None for f in found], pa.int32()),
                pa.array([f[0].message if f else None for f in found], pa.string()),
                pa.array([[x._asdict() for x in f] for f in found], _FAULTS),
                b.column(4),
            ],
            ["file_id", "repo", "language", "faults", "first_line", "first_cause", "all_faults", "other"],
        )


def syntax_verdicts(files: DataFrame) -> DataFrame:
    """One row per file whose extension stands for a language we know and whose content isn't blank:
    the number of faults, the first cause and all of them (none: the grammar accepts the file).

    Rows delivered again give one row. A null path, other extensions and null or blank content give
    none; a null ``repo`` is kept as it is, and files with a null ``file_id`` are told apart by repository, path
    and content. An empty table gives no rows.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    language = F.create_map(*(F.lit(x) for pair in syntax.LANGUAGES.items() for x in pair))[extension]
    rows = files.select("file_id", "repo", language.alias("language"), "content", anonymous("file_id", "repo", "path", "content").alias("other"))
    rows = rows.filter(F.col("language").isNotNull() & F.col("content").rlike(r"\S"))
    return rows.mapInArrow(_judge, VERDICT).dropDuplicates(["file_id", "language", "other"]).drop("other")


def fault_rates(verdicts: DataFrame) -> DataFrame:
    """Per ``repo`` and ``language``: files judged, faulty ones, and their share."""
    faulty = F.count(F.when(F.col("faults") > 0, 1))
    return verdicts.groupBy("repo", "language").agg(F.count("*").alias("files"), faulty.alias("faulty")).withColumn("rate", F.col("faulty") / F.col("files"))
