"""Problem 7: passages of evaluation items in the texts of a corpus.

Spaced-seed hashing: masks of fixed positions are hashed at every word of items and documents alike;
words at positions that a mask leaves out may differ. Hashes that no item has are dropped by a Bloom filter before anything
moves; the others are joined with the items' hashes. Each hit carries the words around it, so that the windows of
RUN words it lies in are verified in the joined row: all but SUBSTITUTED words must be equal. A window that
several hits lie in comes from the first of them only. Windows that follow each other on one alignment make an overlap,
windows of equal words alone a run. Whichever words of a window are the substituted ones, one of the masks
fits in between somewhere, so no window is missed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .hot import salted

#: Words in a row that make a leak, and words of which all but a few may be substituted ones.
RUN, SUBSTITUTED = 12, 3
#: Words that each mask compares: of the 220 ways to substitute SUBSTITUTED of RUN words each leaves one of them somewhere.
MASKS = ((0, 1, 2, 4), (0, 2, 3, 4))
#: Rows of items' seeds that are broadcast (some 20 MB); more are joined by a shuffle.
FEW = 100_000
#: Bits of the Bloom filter for each seed, as long as they are no more than the largest filter has (64 MB); beyond, it lets more pass.
BITS, LARGEST = 32, 1 << 29
#: Words of texts looked up at once, and words whose hashes a worker remembers.
PART, KEPT = 500_000, 1_000_000
#: Words before and after the first word of a seed that its windows may reach.
BEFORE = RUN - 1 - min(m[-1] for m in MASKS)
WIDTH = BEFORE + RUN
_WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = tuple(map(np.uint64, (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)))


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, without regard to case."""
    found = _WORD.findall(text)
    return [w.casefold() for w in found] if not text.isascii() else " ".join(found).lower().split(" ") if found else []


class _Hashes(dict):
    """Words to odd 64-bit hashes; 0 stands for no word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return h


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed at each word, 0 where ``mask`` reaches beyond the text."""
    n = max(0, len(hashes) - mask[-1])
    h, whole = np.full(n, mask[1], np.uint64), np.ones(n, bool)
    for k in mask:
        w = hashes[k : k + n]
        whole &= w > 0
        h = (h ^ w) * _PRIME
        h ^= h >> np.uint64(29)
    return np.where(whole, h | np.uint64(1), np.uint64(0))


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - bits.bit_length() + 1)
    return ((h * k) >> shift for k in _SPREAD)


def passes(h: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in _places(h, len(bloom) * 8):
        found &= (bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


SEEDED = "id bigint, text_id bigint, mask int, seed bigint, at int, words binary"


def _seeded(batches: Iterator[pa.RecordBatch], bloom: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Seeds of texts (``id, text_id, text``) with the words around; all of them, or those that pass ``bloom``."""
    hash_of, gap = _Hashes(), np.zeros(RUN, np.uint64)

    def out(ids: list, text_ids: list, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        line = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
        starts = np.cumsum([RUN, *(len(t) + RUN for t in texts)])
        around = np.lib.stride_tricks.sliding_window_view(line, WIDTH)
        for number, mask in enumerate(MASKS):
            h = seeds(line, mask)
            at = np.flatnonzero(h)
            if bloom is not None:
                at = at[passes(h[at], bloom)]
            owner = np.searchsorted(starts, at, "right") - 1
            context = np.ascontiguousarray(around[at - BEFORE])
            ends = np.arange(len(at) + 1, dtype=np.int32) * (WIDTH * 8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in owner.tolist()], pa.int64()),
                    pa.array([text_ids[k] for k in owner.tolist()], pa.int64()),
                    pa.array(np.full(len(at), number, np.int32)),
                    pa.array(h[at].view(np.int64)),
                    pa.array((at - starts[owner]).astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(context)]),
                ],
                ["id", "text_id", "mask", "seed", "at", "words"],
            )

    for b in batches:
        ids, text_ids, texts, held = [], [], [], 0
        for i, text_id, text in zip(*(c.to_pylist() for c in b.columns)):
            ws = words(text)
            if len(ws) < RUN:
                continue
            ids.append(i)
            text_ids.append(text_id)
            texts.append(np.fromiter(map(hash_of.__getitem__, ws), np.uint64, len(ws)))
            held += len(ws)
            if held >= PART:
                yield from out(ids, text_ids, texts)
                ids, text_ids, texts, held = [], [], [], 0
        if texts:
            yield from out(ids, text_ids, texts)


def _texts(df: DataFrame, key: str) -> DataFrame:
    rows = df.filter(F.length("text") >= 2 * RUN - 1)
    return rows.select(F.col(key).cast("bigint").alias("id"), F.xxhash64("text").alias("text_id"), "text")


def _bloom(held: DataFrame, n: int) -> np.ndarray:
    """The filter of all seeds of ``held``, put together from one of each task."""
    bits = min(LARGEST, 1 << max(10, (n * BITS - 1).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for b in batches:
            for at in _places(b.column(0).to_numpy().view(np.uint64), bits):
                flags[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)], pa.binary())], ["part"])

    whole = np.zeros(bits // 8, np.uint8)
    for r in held.select("seed").coalesce(4).mapInArrow(fill, "part binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(r[0]), np.uint8)
    return whole


def _columns(c: pa.Array) -> np.ndarray:
    """The words of a column of contexts, a row each."""
    ends = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4)
    return np.frombuffer(c.buffers()[2], np.uint64, len(c) * WIDTH, int(ends[0])).reshape(len(c), WIDTH)


WINDOW = "id bigint, text_id bigint, context_id bigint, at int, start int, equal int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the windows around each hit those with enough equal words that no earlier hit lies in, and their longest run of equal words."""
    for b in batches:
        if not b.num_rows:
            continue
        mine, theirs = _columns(b.column(4)), _columns(b.column(5))
        mask, at = b.column(2).to_numpy(), b.column(3).to_numpy()
        there = (mine > 0) & (theirs > 0)
        same = there & (mine == theirs)
        found = []
        for shift in range(BEFORE + 1):  # the window begins so many words before the seed
            s = same[:, BEFORE - shift : BEFORE - shift + RUN]
            good = there[:, BEFORE - shift : BEFORE - shift + RUN].all(1) & (s.sum(1) >= RUN - SUBSTITUTED)
            for k in range(shift + 1):
                for m, places in enumerate(MASKS):
                    if k + places[-1] < RUN:
                        fits = s[:, [k + p for p in places]].all(1)
                        # an earlier seed, or an earlier mask at the same word, brings this window; the row's own must fit
                        good &= ~fits | (mask <= m) if k == shift else ~fits
                        if k == shift:
                            good &= fits | (mask != m)
            rows = np.flatnonzero(good)
            if len(rows):
                found.append((rows, np.full(len(rows), shift), _longest(s[rows])))
        if not found:
            continue
        rows, shift, equal = (np.concatenate(x) for x in zip(*found))
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), b.column(6).take(take), b.column(3).take(take), pa.array((at[rows] - shift).astype(np.int32)), pa.array(equal.astype(np.int32))],
            ["id", "text_id", "context_id", "at", "start", "equal"],
        )


def _longest(same: np.ndarray) -> np.ndarray:
    """The longest run of equal words in each row."""
    now, best = np.zeros(len(same), np.int32), np.zeros(len(same), np.int32)
    for k in range(same.shape[1]):
        now = np.where(same[:, k], now + 1, 0)
        best = np.maximum(best, now)
    return best


LEAK = "doc_id bigint, item_id bigint, run int, overlap int, at_word int"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, run, overlap, at_word`` for every document and item that share a passage.

    ``overlap`` counts the words of the longest stretch in which any RUN words have at most SUBSTITUTED
    others, and ``at_word`` is where that begins; ``run`` is the most equal words in a row within any such stretch. A pair is listed
    if ``overlap`` reaches RUN, as it does where ``run`` does. Texts that are null,
    empty or shorter have no passage. Items with the same text are found one by one. A document
    delivered twice gives one row, different texts of one ``doc_id``, or of none (null), a row each; the same holds for items. Without items there are no rows.
    """
    spark = documents.sparkSession
    held = cut(_texts(items, "item_id").distinct().mapInArrow(lambda it: _seeded(it, None), SEEDED).withColumn("context_id", F.xxhash64("mask", "words")))
    n = held.count()
    if not n:
        return spark.createDataFrame([], LEAK)
    few = F.broadcast if n <= FEW else lambda df: df
    bits = spark.sparkContext.broadcast(_bloom(held, n))
    hits = _texts(documents, "doc_id").mapInArrow(lambda it: _seeded(it, bits.value), SEEDED)
    contexts = held.select("seed", "context_id", F.col("words").alias("theirs")).dropDuplicates(["seed", "context_id"])
    if n <= FEW:
        met = hits.join(few(contexts), "seed")
    else:
        asked, offered = salted(cut(hits), contexts, "seed", ["text_id", "at"])
        met = asked.join(offered, ["seed", "salt"])
    windows = met.select("id", "text_id", "mask", "at", "words", "theirs", "context_id").mapInArrow(_verify, WINDOW)
    of_items = held.select("context_id", F.col("id").alias("item_id"), F.col("text_id").alias("item_text"), F.col("at").alias("item_at"))
    if n > FEW:
        windows, of_items = salted(cut(windows), of_items, "context_id", ["text_id", "at"])
    met = windows.join(few(of_items), ["context_id"] if n <= FEW else ["context_id", "salt"])
    return _passages(met.select(F.col("id").alias("doc_id"), "text_id", "item_id", "item_text", (F.col("item_at") - F.col("at")).alias("diagonal"), "start", "equal"))


def _passages(windows: DataFrame) -> DataFrame:
    """The longest run and overlap of each document and item, from the windows that follow each other on one alignment."""
    pair = ["doc_id", "text_id", "item_id", "item_text"]
    # delivered again, a document's windows come again; all that follows needs no further shuffle
    rows = windows.repartition(*pair).dropDuplicates([*pair, "diagonal", "start"]).withColumn("whole", F.col("equal") == RUN)
    place = lambda *keys: F.col("start") - F.row_number().over(Window.partitionBy(*pair, "diagonal", *keys).orderBy("start"))
    rows = rows.withColumn("stretch", place()).withColumn("island", place("whole"))
    longest = F.when(F.col("whole"), F.count("*") + RUN - 1).otherwise(F.max("equal"))
    parts = rows.groupBy(*pair, "diagonal", "stretch", "whole", "island").agg(longest.alias("run"), F.min("start").alias("begin"), F.count("*").alias("n"))
    stretches = parts.groupBy(*pair, "diagonal", "stretch").agg(F.max("run").alias("run"), F.min("begin").alias("begin"), (F.sum("n") + RUN - 1).alias("overlap"))
    best = stretches.groupBy(*pair).agg(F.max("run").alias("run"), F.max(F.struct("overlap", (-F.col("begin")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("run").cast("int"), F.col("b.overlap").cast("int").alias("overlap"), (-F.col("b.back")).cast("int").alias("at_word"))
