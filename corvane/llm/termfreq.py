"""Problem 1: how often, and in how many records, every distinct term occurs.

Burst-trie counting. Workers put the terms of their partition into a burst trie (leaf containers
that burst into a node by the next character when full) whose leaves are dense slots; occurrences
are gathered per slot and record, made distinct, and written once as compact partial counters. From
these, prefixes are burst as long as they weigh more than a share of all occurrences: the resulting
routes, of bounded number, decide which worker merges which subtree. A single term heavier than a
route is split by record, which keeps both counters additive, so they stay exact under any skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, partitions

#: Entries of a leaf container before it bursts, and rows a worker buffers before it writes partial counters.
CONTAINER, BUFFER = 128, 1_000_000
#: Routes per shuffle partition; more routes spread more evenly.
ROUTES = 4

PARTIAL = "term string, record bigint, n int, places binary"
MERGED = "term string, occurrences bigint, records bigint"


class BurstTrie:
    """Terms to dense slots. A node maps a character to a node or a container, a container suffixes to slots."""

    def __init__(self, limit: int = CONTAINER):
        self.limit, self.root, self.terms = limit, {}, []

    def slot(self, term: str) -> int:
        node, depth = self.root, 0
        while True:
            head = term[depth : depth + 1]
            child = node.get(head)
            depth += 1
            if child is None:
                child = node[head] = _Container()
            if type(child) is dict:
                if not head:
                    raise AssertionError("a term can't go on past its end")
                node = child
                continue
            rest = term[depth:]
            at = child.get(rest)
            if at is None:
                at = child[rest] = len(self.terms)
                self.terms.append(term)
                if head and len(child) > self.limit:
                    node[head] = self._burst(child)
            return at

    @staticmethod
    def _burst(full: _Container) -> dict:
        node: dict = {}
        for suffix, at in full.items():
            node.setdefault(suffix[:1], _Container())[suffix[1:]] = at
        return node


class _Container(dict):
    """Suffixes and their slots, below one prefix."""


def _flush(trie: BurstTrie, parts: list[tuple]) -> pa.RecordBatch:
    slot, record, place = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((place, record, slot))
    slot, record, place = slot[order], record[order], place[order]
    same = (slot[1:] == slot[:-1]) & (record[1:] == record[:-1])
    keep = np.r_[True, ~(same & (place[1:] == place[:-1]))]
    slot, record, place = slot[keep], record[keep], place[keep]
    first = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (record[1:] != record[:-1])])
    ends = np.r_[first, len(slot)].astype(np.int32)
    places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * 4), pa.py_buffer(place.astype(np.int32))])
    terms = pa.array(trie.terms, pa.string()).take(pa.array(slot[first]))
    return pa.RecordBatch.from_arrays([terms, pa.array(record[first]), pa.array(np.diff(ends)), places], ["term", "record", "n", "places"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, parts, held = BurstTrie(), [], 0
    for b in batches:
        if not b.num_rows:
            continue
        coded = b.column(0).dictionary_encode()
        slots = np.fromiter(map(trie.slot, coded.dictionary.to_pylist()), np.int64)
        parts.append((slots[coded.indices.to_numpy()], b.column(1).to_numpy(), b.column(2).to_numpy()))
        held += b.num_rows
        if held >= BUFFER:
            yield _flush(trie, parts)
            trie, parts, held = BurstTrie(), [], 0
    if held:
        yield _flush(trie, parts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counters sorted by term and record, so that equal subtrees meet in trie order."""
    held: list[pa.RecordBatch] = []

    def out(b: pa.RecordBatch) -> pa.RecordBatch:
        coded = b.column(0).dictionary_encode()
        slot, record, n = coded.indices.to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
        fresh = np.r_[True, (slot[1:] != slot[:-1]) | (record[1:] != record[:-1])]
        first = np.flatnonzero(fresh)
        size = np.diff(np.r_[first, len(slot)])
        total = n[first].copy()
        for i in np.flatnonzero(size > 1):  # a record met by several workers: count each place once
            at = range(first[i], first[i] + size[i])
            total[i] = len(np.unique(np.concatenate([np.frombuffer(b.column(3)[j].as_py(), np.int32) for j in at])))
        k = len(coded.dictionary)
        occurrences = np.bincount(slot[first], weights=total, minlength=k).astype(np.int64)
        return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(occurrences), pa.array(np.bincount(slot[first], minlength=k).astype(np.int64))], ["term", "occurrences", "records"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        # all but the last (term, record) are complete; a term cut here is added up by the final sum
        term, record = b.column(0), b.column(1)
        last = b.num_rows - 1
        while last > 0 and term[last - 1] == term[b.num_rows - 1] and record[last - 1] == record[b.num_rows - 1]:
            last -= 1
        if last:
            whole = pa.Table.from_batches([*held[:-1], b.slice(0, last)]).combine_chunks().to_batches()
            yield out(whole[0])
            held = [b.slice(last)]
        elif len(held) > 1 and (held[0].column(0)[0] != term[0] or held[0].column(1)[0] != record[0]):
            yield out(pa.Table.from_batches(held[:-1]).combine_chunks().to_batches()[0])
            held = [b]
    if held:
        yield out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _common(a: str, b: str) -> int:
    """Characters that two terms, and so all terms between them, begin with."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _routes(partial: DataFrame, most: int) -> tuple[list[str], int, list[tuple[int, list[str]]]]:
    """Terms, and prefixes by their depth, heavier than a route may be. At most ROUTES times the shuffle
    partitions of each depth can be, whatever the input. What all terms below the heavy prefixes of a depth have in common is passed over
    in one step, so that long common beginnings, as of addresses, cost no job per character."""
    weight = cut(partial.groupBy("term").agg(F.sum("n").alias("n")))
    total = weight.agg(F.sum("n")).first()[0] or 0
    limit = max(1, total // most)
    heavy = {r[0]: r[1] for r in weight.filter(F.col("n") > limit).collect()}
    light, bursts, depth = weight.filter(~F.col("term").isin(*heavy)) if heavy else weight, [], 1
    while True:
        prefix = F.substring("term", 1, depth)
        rows = light.groupBy(prefix.alias("p")).agg(F.sum("n").alias("n"), F.min("term").alias("low"), F.max("term").alias("high")).filter(F.col("n") > limit).collect()
        if not rows:
            return list(heavy), max([1, *(-(-n // limit) for n in heavy.values())]), [*bursts, (depth, [])]
        full = [r["p"] for r in rows]
        bursts.append((depth, full))
        light = light.filter(prefix.isin(*full) & (F.length("term") > depth))
        depth = max(depth, min(_common(r["low"], r["high"]) for r in rows)) + 1


def _route(heavy: list[str], salts: int, bursts: list[tuple[int, list[str]]]) -> Column:
    """The prefix at the first depth at which it isn't heavy, as none is at the last one."""
    route = F.substring("term", 1, bursts[-1][0])
    for depth, full in reversed(bursts[:-1]):
        p = F.substring("term", 1, depth)
        route = F.when(~p.isin(*full), p).otherwise(route)
    if heavy:
        salt = F.pmod(F.xxhash64("record"), F.lit(salts)).cast("string")
        route = F.when(F.col("term").isin(*heavy), F.concat_ws("\u0000", "term", salt)).otherwise(route)
    return route


def term_frequencies(df: DataFrame, term: str, record: str, place: str | None = None, most_share: float = 0.5) -> DataFrame:
    """``term, occurrences, records, mark`` for every distinct term.

    An occurrence is a distinct (term, record, place), so rows delivered again count once; without
    ``place``, or where it is null, a term occurs once per record. Rows whose term or record is null
    don't count; the empty string is a term. ``mark`` is ``rare`` for terms of one record, else
    ``common`` for those in more than ``most_share`` of all counted records, else null. An empty
    table gives no rows; other columns, whatever their names, are ignored. ``record`` must be integral.
    """
    spark = df.sparkSession
    if dict(df.dtypes)[record] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{record!r} must be integral; number the records first")
    at = F.coalesce(F.col(place).cast("int"), F.lit(-1)) if place else F.lit(-1)
    rows = df.select(F.col(term).cast("string").alias("term"), F.col(record).cast("bigint").alias("record"), at.alias("place"))
    rows = rows.filter(F.col("term").isNotNull() & F.col("record").isNotNull())
    partial = cut(rows.mapInArrow(_count, PARTIAL))
    n = partitions(spark)
    routed = partial.withColumn("route", _route(*_routes(partial, ROUTES * n)))
    merged = routed.repartition(n, "route").drop("route").sortWithinPartitions("term", "record").mapInArrow(_merge, MERGED)
    whole = merged.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    every = partial.select("record").distinct().count()
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > F.lit(most_share * every), "common")
    return whole.withColumn("mark", mark)


def trigram_frequencies(trigrams: DataFrame) -> DataFrame:
    """Counted are strings of exactly three code points with a file, whether or not that is still in ``files``."""
    return term_frequencies(trigrams.filter(F.length("trigram") == 3), "trigram", "file_id", "pos").withColumnRenamed("term", "trigram")
