"""Problem 6: texts of varying length in windows of fixed capacity.

Optimal length buckets: the histogram of all lengths, which has no more entries than a window has
tokens, goes to the driver, where dynamic programming chooses the bucket boundaries that minimise
padding. Windows are planned on the buckets' counts alone: each takes as many items of the largest
bucket left as it holds, then of smaller ones in what room remains; a plan line covers all windows
of one pattern. Items get their rank within their bucket by counts per salt, so that no bucket is
ever sorted in one task, and rank and plan give the window.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, partitions

#: Tokens of a window, buckets of lengths, and where the public vocabulary lies.
CAPACITY, BUCKETS, VOCABULARY = 2048, 512, "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters handed to the tokenizer at once, up to the next space between words.
PART = 100_000
#: Parts of a bucket, at most, that are ranked apart.
SALTS = 256
#: How the vocabulary's texts fall into words before byte pairs merge (a fixed value of the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A space between two words: the words' pattern always cuts before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space, as the vocabulary has it, too long for the pattern's matcher.
_GAP = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    """As the tokenizer has it for the whole text: long ones are handed over in parts that end where words do."""
    e = encoding(vocabulary)
    if len(text) <= PART:
        return len(e.encode_ordinary(text))
    total, at = 0, 0
    for gap in _GAP.finditer(text):
        # all of a gap but what its last character begins is one word
        end = gap.end() if gap.end() == len(text) else gap.end() - 1
        total += _in_parts(e, text[at : gap.start()]) + len(e._encode_single_piece(text[gap.start() : end]))
        at = end
    return total + _in_parts(e, text[at:])


def _in_parts(e, text: str) -> int:
    total, at = 0, 0
    while len(text) - at > PART and (m := _CUT.search(text, at + PART)):
        total += len(e.encode_ordinary(text[at : m.start()]))
        at = m.start()
    return total + len(e.encode_ordinary(text[at:]))


def token_counts(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, size``; the vocabulary goes to executors that lack it."""
    if os.path.exists(vocabulary):
        documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        at = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count_tokens(t, at) for t in b.column(1).to_pylist()], pa.int64())], [key, "size"])

    rows = documents.filter(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias(key), text)
    return rows.mapInArrow(count, f"`{key}` bigint, size bigint")


def _levels(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """1 to n - 1 halved again and again: the middles of each level, and the places before and after that are known by then."""
    levels, todo = [], [(1, n - 1, 0, n)]
    while todo:
        middles = [((a + b) // 2, left, right) for a, b, left, right in todo]
        levels.append(tuple(np.array(x) for x in zip(*middles)))
        halves = [(part, m) for (a, b, left, right), (m, _, _) in zip(todo, middles) for part in ((a, m - 1, left, m), (m + 1, b, m, right))]
        todo = [part for part, _ in halves if part[0] <= part[1]]
    return levels


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper ends of at most ``buckets`` buckets with the least padding, by dynamic programming.

    Where the last bucket of the best division begins never moves back as lengths are added, so each
    bucket costs n log n steps: the middle length first, then those on either side within its bounds.
    """
    n, k = len(lengths), min(buckets, len(lengths))
    if k == n:
        return lengths.copy()
    size = lengths.astype(float)
    number, total = np.r_[0, np.cumsum(counts)].astype(float), np.r_[0, np.cumsum(counts * lengths)].astype(float)
    best, cuts, levels = size * number[1:] - total[1:], [], _levels(n)
    for _ in range(k - 1):
        new, at = np.full(n, np.inf), np.zeros(n + 1, np.int64)
        at[0], at[n] = 1, n - 1
        for middle, left, right in levels:
            low = at[left]
            many = np.minimum(at[right], middle) - low + 1
            starts = np.cumsum(many) - many
            of = np.repeat(np.arange(len(middle)), many)
            i, j = low[of] + np.arange(len(of)) - starts[of], middle[of]
            value = best[i - 1] + size[j] * (number[j + 1] - number[i]) - (total[j + 1] - total[i])
            least = np.minimum.reduceat(value, starts)
            new[middle], at[middle] = least, np.minimum.reduceat(np.where(value <= least[of], i, n), starts)
        cuts.append(np.where(new < best, at[:n], -1))
        best = np.minimum(best, new)
    ends, j = [], n - 1
    for at in [*reversed(cuts), None]:
        if at is not None and at[j] < 0:
            continue
        ends.append(lengths[j])
        if at is None:
            break
        j = at[j] - 1
    return np.array(ends[::-1])


def plan(upper: np.ndarray, counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Lines ``bucket, low, high, each, window``: ranks low to high - 1 lie ``each`` to a window from ``window`` on."""
    left, taken, window, lines = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), 0, []
    while left.any():
        room, pattern = capacity, {}
        for b in range(len(upper) - 1, -1, -1):
            if left[b] and upper[b] <= room:
                pattern[b] = int(min(left[b], room // upper[b]))
                room -= pattern[b] * int(upper[b])
        times = min(int(left[b] // c) for b, c in pattern.items())
        for b, c in pattern.items():
            lines.append((b, taken[b], taken[b] + times * c, c, window))
            taken[b] += times * c
            left[b] -= times * c
        window += times
    return pd.DataFrame(lines, columns=["bucket", "low", "high", "each", "window"]).astype(np.int64)


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``key, part, start, size, window_id``: each item in one window, whole unless it is larger than the window.

    A larger item becomes parts of a full window each and a rest; the rest is packed like an item.
    Items of size 0 lie in window 0; those of null size are left out, null keys are kept. The sizes in
    a window never add up to more than ``capacity``. No items give no windows.
    """
    spark = items.sparkSession
    salts = max(8, min(SALTS, partitions(spark)))
    parts = F.greatest(F.lit(1), F.ceil(F.col(size) / capacity)).cast("int")
    rows = items.filter(F.col(size) >= 0).select(key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col(size).cast("bigint").alias("whole"))
    start = F.col("part").cast("bigint") * capacity
    rows = rows.select(key, "part", start.alias("start"), F.least(F.col("whole") - start, F.lit(capacity)).cast("bigint").alias("size"))
    rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64(key, "part"), F.lit(salts)).cast("int")))
    # at most capacity times SALTS lines
    counted = rows.filter("size > 0").groupBy("size", "salt").count().toPandas()
    if counted.empty:
        return rows.drop("salt").withColumn("window_id", F.lit(0).cast("bigint"))
    histogram = counted.groupby("size")["count"].sum().sort_index()
    lengths, counts = histogram.index.to_numpy(np.int64), histogram.to_numpy(np.int64)
    upper = boundaries(lengths, counts, buckets)
    of_size = np.searchsorted(upper, np.arange(capacity + 1))
    counted["bucket"] = of_size[counted["size"].to_numpy()]
    # where the ranks of a bucket's salt begin
    per = counted.groupby(["bucket", "salt"])["count"].sum().sort_index()
    offsets = (per.groupby(level="bucket").cumsum() - per).rename("offset").reset_index()
    lines = plan(upper, per.groupby(level="bucket").sum().to_numpy(np.int64), capacity)
    bucket = F.element_at(F.lit([int(min(b, len(upper) - 1)) for b in of_size]), (F.col("size") + 1).cast("int"))
    own = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(key, "part"))
    ranked = rows.filter("size > 0").withColumn("bucket", bucket.cast("bigint")).withColumn("own", own)
    ranked = ranked.join(F.broadcast(spark.createDataFrame(offsets.astype(np.int64))), ["bucket", "salt"]).withColumn("rank", F.col("offset") + F.col("own") - 1)
    lines = F.broadcast(spark.createDataFrame(lines))
    held = ranked.join(lines, (ranked["bucket"] == lines["bucket"]) & (ranked["rank"] >= lines["low"]) & (ranked["rank"] < lines["high"]))
    window = (F.col("window") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("bigint")
    return held.select(key, "part", "start", "size", window.alias("window_id")).unionByName(rows.filter("size = 0").drop("salt").withColumn("window_id", F.lit(0).cast("bigint")))


def windows_of_documents(documents: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(token_counts(documents, "doc_id", "text", vocabulary), "doc_id", "size", capacity, buckets)


def fill(windows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: windows, tokens, and the share of their room that is used."""
    n = F.countDistinct(F.when(F.col("size") > 0, F.col("window_id")))
    return windows.agg(n.alias("windows"), F.sum("size").alias("tokens")).withColumn("filled", F.col("tokens") / (F.col("windows") * capacity))
