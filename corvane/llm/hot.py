"""Keys: those that a large part of all rows hold, split for a join, and those that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows of one key that one task joins.
HOT = 500_000


def anonymous(key: str, *others: str) -> Column:
    """What tells rows without a key apart, by all their ``others``; null for rows that have one."""
    return F.when(F.col(key).isNull(), F.xxhash64(*others))


def salted(asked: DataFrame, held: DataFrame, key: str, by: list[str], weight: Column | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both with a ``salt`` to join on beside ``key``: rows of ``asked`` whose key weighs more than ``limit`` are
    dealt out by the columns ``by``, and the rows of ``held`` it meets are repeated once per part. Such keys are fewer than the weight
    of all rows divided by ``limit``, which bounds what is broadcast."""
    limit, weight = limit or HOT, F.count("*") if weight is None else weight
    parts = F.least(F.count("*"), F.ceil(weight / limit)).cast("int")
    hot = cut(asked.groupBy(key).agg(weight.alias("weight"), parts.alias("salts")).filter(F.col("weight") > limit).select(key, "salts"))
    if hot.isEmpty():
        return asked.withColumn("salt", F.lit(0)), held.withColumn("salt", F.lit(0))
    n = F.coalesce("salts", F.lit(1))
    asked = asked.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(*by), n).cast("int")).drop("salts")
    return asked, held.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
