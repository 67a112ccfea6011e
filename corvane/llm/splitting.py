"""Problem 5: items over a size limit, cut into pieces at natural boundaries.

Every boundary of an item (paragraph, line, in long lines word, in long words a grid) points to its
farthest legal successor: the last one up to which the piece, with the overlap it repeats, keeps
within the limit, preferring paragraphs in the second half of that reach, then lines, then words.
Squaring this successor table again and again (pointer doubling) marks the greedy cuts of all items of
a batch at once, in as many steps as the logarithm of the pieces of the longest item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import anonymous

#: Characters of a piece together with what it repeats, and of the end of the piece before that it repeats.
LIMIT, OVERLAP, CUT_MARK = 800, 160, "..."
WORD, LINE, PARAGRAPH = 0, 1, 2
_SPACE, _END = re.compile(r"\s+"), re.compile(r"\n")


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, from 0 to its end, and how natural each is."""
    size = len(text)
    ends = np.fromiter((m.end() for m in _END.finditer(text)), np.int64)
    # the first line, and the lines that begin at each end
    begin = np.r_[0, ends]
    lengths = np.diff(np.r_[begin, size])
    at, rank = begin, np.full(len(begin), LINE, np.int64)
    for i in range(1, len(begin)):
        p = begin[i]
        if p < size and not text[p].isspace() and (text[p] not in ")]}" or not text[begin[i - 1] : p].strip()):
            rank[i] = PARAGRAPH
    if (lengths > reach).any():
        more = [at]
        for i in np.flatnonzero(lengths > reach):
            s = int(begin[i])
            more.append(np.fromiter((m.end() for m in _SPACE.finditer(text, s, s + int(lengths[i]))), np.int64))
        words = np.setdiff1d(np.concatenate(more[1:]), at)
        at, rank = np.r_[at, words], np.r_[rank, np.full(len(words), WORD)]
        order = np.argsort(at, kind="stable")
        at, rank = at[order], rank[order]
        gaps = np.diff(np.r_[at, size])
        grid = [np.arange(at[i] + reach, at[i] + gaps[i], reach) for i in np.flatnonzero(gaps > reach)]
        if grid:
            more = np.concatenate(grid)
            at, rank = np.r_[at, more], np.r_[rank, np.full(len(more), WORD)]
            order = np.argsort(at, kind="stable")
            at, rank = at[order], rank[order]
    if at[-1] != size:
        at, rank = np.r_[at, size], np.r_[rank, PARAGRAPH]
    return at, rank


def cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[np.ndarray]:
    """The positions at which each text begins a piece, and its end."""
    later = limit - overlap - len(CUT_MARK) if overlap else limit
    found = [boundaries(t, later) for t in texts]
    sizes = np.array([len(a) for a, _ in found])
    first = np.r_[0, np.cumsum(sizes)]
    # one number line for all texts, too far apart for a piece to span two
    shift = np.r_[0, np.cumsum([int(a[-1]) + 2 * limit for a, _ in found])][:-1]
    place = np.concatenate([a + s for (a, _), s in zip(found, shift)])
    rank = np.concatenate([r for _, r in found])
    n = np.arange(len(place))
    reach = np.full(len(place), later)
    reach[first[:-1]] = limit
    far = np.searchsorted(place, place + reach, "right") - 1
    end = np.repeat(first[1:] - 1, sizes)
    to = far.copy()
    for level, least in ((LINE, 0.0), (PARAGRAPH, 0.5)):
        last = np.maximum.accumulate(np.where(rank >= level, n, -1))[far]
        good = (last > n) & (place[np.maximum(last, 0)] > place + least * reach)
        to = np.where(good, last, to)
    to = np.where(far >= end, end, to)
    marked = np.zeros(len(place), bool)
    marked[first[:-1]] = True
    while True:
        before = np.count_nonzero(marked)
        marked[to[marked]] = True
        if np.count_nonzero(marked) == before:
            break
        to = to[to]
    return [a[marked[f : f + k]] for (a, _), f, k in zip(found, first, sizes)]


def _keep(text: str, overlap: int) -> str:
    return "" if not overlap else text if len(text) <= overlap else CUT_MARK + text[-overlap:]


PIECE = "id string, file_path string, piece int, content string, start_line int, end_line int, context_prev string, other bigint"


def _pieces(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            ids, paths, texts, starts, contexts, others = (c.to_pylist() for c in whole.slice(start, 1000).columns)
            columns: list[list] = [[] for _ in types]
            for i, path, text, line, context, other, at in zip(ids, paths, texts, starts, contexts, others, cuts(texts, limit, overlap)):
                at = at.tolist()
                now = line
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    piece = text[a:b]
                    until = None if now is None else now + piece.count("\n", 0, -1)
                    for column, value in zip(columns, (i, path, k, piece, now, until, context, other)):
                        column.append(value)
                    now = None if now is None else until + (piece[-1] == "\n")
                    context = _keep(piece, overlap)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "file_path", "piece", "content", "start_line", "end_line", "context_prev", "other"])


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk whose content has more than ``limit`` characters (code points).

    Piece and ``context_prev`` together keep within ``limit``; the pieces put together are the content
    again. ``context_prev`` of the first piece is the chunk's own, of later ones the last ``overlap``
    characters of the piece before, led by ``...`` where that is longer. A piece that ends or begins
    within a line has that line as ``end_line`` or ``start_line``; both are null where the chunk's
    ``start_line`` is. Rows of one ``id`` delivered again give its pieces once, and chunks with a null ``id`` are told apart by
    path, line and content; null content gives none.
    """
    if overlap and limit < 2 * overlap + 2 * len(CUT_MARK):
        raise ValueError("the overlap must be less than half of the limit")
    rows = chunks.filter(F.length("content") > limit).select("id", "file_path", "content", F.col("start_line").cast("int"), "context_prev", anonymous("id", "file_path", "start_line", "content").alias("other"))
    return rows.mapInArrow(lambda it: _pieces(it, limit, overlap), PIECE).dropDuplicates(["id", "piece", "other"]).drop("other")
