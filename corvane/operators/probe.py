"""Symbols that a text refers to and doesn't define, and where they may be defined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import bm25


def symbols(texts: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, symbol`` of every missing one."""
    return texts.select(key, F.explode(X.missing_symbols(F.col(content))).alias("symbol"))


def questions(wanted: DataFrame) -> DataFrame:
    """``qid, term`` of the query "<symbol> definition" for each ``symbol``."""
    return wanted.select(F.col("symbol").alias("qid"), F.explode(X.code_tokens(F.concat("symbol", F.lit(" definition")))).alias("term"))


def best(chunks: DataFrame, wanted: list[str], limit: int = 1) -> DataFrame:
    """``symbol, id, score, rank``: for each symbol the chunks that answer "<symbol> definition", in one pass for all."""
    asked = questions(chunks.sparkSession.createDataFrame([(s,) for s in wanted], "symbol string"))
    found = bm25.search_corpus(chunks, "id", X.code_tokens(bm25.documents(chunks)), asked, limit, once=True)
    return found.withColumnRenamed("qid", "symbol")
