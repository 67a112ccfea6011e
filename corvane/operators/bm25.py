"""Ranked search by BM25+ over distinct tokens: term frequency is always one.

    score = delta * sum(idf(t), t in query and vocabulary)
          + sum(idf(t) * (k1 + 1) / (k1 * (1 - b + b * dl / avgdl) + 1), t in query and document)

with idf(t) = ln((N + 1) / df). A search reads its corpus once; what the driver holds of it are N,
avgdl and the df of the query's terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import query_text
from ..functions import text as X
from ..session import cut, spread

K1, B, DELTA = 1.5, 0.75, 0.5
#: Rows of queries and their terms that are broadcast.
FEW = 100_000


def documents(chunks: DataFrame) -> Column:
    """What a chunk is searched by: its name, content and path."""
    return F.concat_ws(" ", "name", "content", "file_path")


def query_tokens(df: DataFrame, query: str, tokens=X.code_tokens) -> list[str]:
    return df.sparkSession.range(1).select(tokens(F.lit(query_text(query)))).first()[0]


def postings(corpus: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``term, key, dl``: the inverted index, a row per term and document."""
    return corpus.select(key, tokens.alias("tokens")).select(F.explode("tokens").alias("term"), key, F.size("tokens").alias("dl"))


def terms(posting: DataFrame, n: int) -> DataFrame:
    """``term, df, idf``."""
    return posting.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(n + 1)) / F.col("df")))


def score_all(corpus: DataFrame, tokens: Column, query: list[str], *, require_overlap: bool = True, keep: list[str] | None = None, once: str | None = None) -> DataFrame:
    """``corpus``, or its columns ``keep``, with a ``score``; without ``require_overlap`` documents that share
    no term keep the constant part. Of rows with the same ``once``, delivered again, one counts.

    Texts are read once and go no further: what is kept of a document are those columns, its length
    and the terms it shares with the query. The counts that scores need are taken in the same pass that writes the hits.
    """
    words = sorted(set(query))
    columns = keep or corpus.columns
    if not words:
        return corpus.select(*columns).limit(0).withColumn("score", F.lit(0.0))
    held = spread(corpus).select(*columns, tokens.alias("_t")).select(*columns, F.size("_t").alias("_dl"), F.array_intersect("_t", F.array(*map(F.lit, words))).alias("_hits"))
    held = held.dropDuplicates([once]) if once else held
    seen = Observation()
    held = held.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("average"), *(F.count_if(F.array_contains("_hits", w)).alias(f"df{k}") for k, w in enumerate(words)))
    held = cut(held.filter(F.size("_hits") > 0) if require_overlap else held)
    counts = seen.get
    n, average, dfs = counts["n"], counts["average"], {w: counts[f"df{k}"] for k, w in enumerate(words)}
    idf = {w: math.log((n + 1) / df) for w, df in dfs.items() if df}
    if not idf:
        return held.limit(0).drop("_dl", "_hits").withColumn("score", F.lit(0.0))
    weight = F.create_map(*(F.lit(x) for pair in sorted(idf.items()) for x in pair))
    inside = F.aggregate(F.array_sort("_hits"), F.lit(0.0), lambda a, t: a + weight[t])
    norm = (K1 + 1) / (K1 * (1 - B + B * F.col("_dl") / F.lit(average)) + 1)
    return held.withColumn("score", F.lit(DELTA * sum(idf[w] for w in sorted(idf))) + inside * norm).drop("_dl", "_hits")


def search(chunks: DataFrame, query: str, limit: int = 10, *, min_score: float | None = None, require_overlap: bool = True, tokens=X.code_tokens) -> DataFrame:
    """The ``limit`` best chunks, ties by path and line; ``min_score`` is applied after the limit.

    Rows of one id delivered again give one. Contents are read again for the chunks found only."""
    scored = score_all(chunks, tokens(documents(chunks)), query_tokens(chunks, query, tokens), require_overlap=require_overlap, keep=["id", "file_path", "start_line"], once="id")
    best = cut(scored.filter("score > 0").orderBy(F.col("score").desc(), "file_path", "start_line", "id").limit(limit).select("id", "score"))
    found = chunks.join(F.broadcast(best) if limit <= FEW else best, "id").dropDuplicates(["id"]).orderBy(F.col("score").desc(), "file_path", "start_line", "id")
    return found.filter(F.col("score") >= min_score) if min_score is not None else found


def search_many(posting: DataFrame, n: int, average: float, queries: DataFrame, key: str, limit: int) -> DataFrame:
    """``qid, key, score, rank``: many queries at once over the inverted index; ``queries`` has ``qid, term``.

    The queries' terms alone are read of the index; sums are made per query and document before
    ranking, and the rank is limited within each task before any row is moved for it.
    """
    wanted = queries.select("term").distinct()
    # few terms go to the postings, which then needn't move and can't be skewed by a common one
    small = F.broadcast if wanted.limit(FEW + 1).count() <= FEW else lambda df: df
    mine = posting.join(small(wanted), "term", "left_semi")
    asked = queries.distinct()
    hits = mine.join(small(terms(mine, n)), "term").join(F.broadcast(asked) if asked.limit(FEW + 1).count() <= FEW else asked, "term")
    norm = F.col("idf") * (K1 + 1) / (K1 * (1 - B + B * F.col("dl") / average) + 1)
    scored = hits.groupBy("qid", key).agg(F.sum(norm).alias("score"))
    # sums differ in their last digits by the order of addition; equal scores must go by key
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


#: Queries that a worker scores documents for at once, and documents.
QUERIES, DOCUMENTS = 2_000, 1_000


def search_corpus(corpus: DataFrame, key: str, tokens: Column, queries: DataFrame, limit: int, *, once: bool = False) -> DataFrame:
    """``qid, key, score, rank``: as ``search_many``, over documents that are not indexed.

    All terms of a document are in its row, so each task adds up its documents' scores itself and hands on its
    ``limit`` best of each query; what moves is no more than that per task. Texts are read once: documents are reduced to the queries'
    terms they hold, and counted, in the pass that writes these. ``once``: rows of the same key, delivered again, count as one.
    Queries of more than FEW terms go by the inverted index.
    """
    spark = corpus.sparkSession
    asked = cut(queries.select("qid", "term").distinct())
    vocabulary = [r[0] for r in asked.select("term").distinct().limit(FEW + 1).collect()]
    rows = spread(corpus).select(key, tokens.alias("_t"))
    if len(vocabulary) > FEW or asked.limit(10 * FEW + 1).count() > 10 * FEW:
        rows = rows.dropDuplicates([key]) if once else rows
        n, average = rows.agg(F.count("*"), F.avg(F.size("_t"))).first()
        return search_many(postings(rows, key, F.col("_t")), n, average or 1.0, asked, key, limit)
    held = rows.select(key, F.size("_t").alias("dl"), F.filter("_t", lambda t: t.isin(vocabulary)).alias("hits"))
    seen = Observation()
    held = (held.dropDuplicates([key]) if once else held).observe(seen, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("average"))
    held = cut(held.filter(F.size("hits") > 0))
    n, average = seen.get["n"], seen.get["average"] or 1.0
    idf = {r[0]: math.log((n + 1) / r[1]) for r in held.select(F.explode("hits").alias("term")).groupBy("term").count().collect()}
    by_term: dict[str, list[int]] = {}
    names = sorted({r[0] for r in asked.select("qid").distinct().collect()}, key=lambda q: (q is None, q))
    number = {q: k for k, q in enumerate(names)}
    for q, t in asked.collect():
        if t in idf:
            by_term.setdefault(t, []).append(number[q])
    shared = spark.sparkContext.broadcast((idf, by_term))
    kind = held.schema[key].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, by_term = shared.value
        asking = {t: np.array(qs, np.int64) for t, qs in by_term.items()}
        best: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # query, score, key
        arrow = None

        def kept(parts):
            q, s, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts])
            order = np.lexsort((pc.rank(k, sort_keys="ascending").to_numpy(), -np.round(s, 9), q))
            q = q[order]
            first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            order = order[place < limit]
            return [(q[place < limit], s[order], k.take(pa.array(order)))]

        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                b = whole.slice(at, DOCUMENTS)
                arrow = b.column(0).type
                lists = b.column(2)
                terms = lists.flatten().to_pylist()
                of = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                known = [k for k, t in enumerate(terms) if t in asking]
                many = np.array([len(asking[terms[k]]) for k in known], np.int64)
                if not len(known):
                    continue
                q, d = np.concatenate([asking[terms[k]] for k in known]), np.repeat(of[known], many)
                w = np.repeat(np.array([idf[terms[k]] for k in known]), many)
                norm = (K1 + 1) / (K1 * (1 - B + B * b.column(1).to_numpy() / average) + 1)
                for low in range(0, int(q.max()) + 1, QUERIES):
                    mine = (q >= low) & (q < low + QUERIES)
                    total = np.bincount(d[mine] * QUERIES + q[mine] - low, w[mine], b.num_rows * QUERIES)
                    place = np.flatnonzero(total)
                    best.append((place % QUERIES + low, total[place] * norm[place // QUERIES], b.column(0).take(pa.array(place // QUERIES))))
                best = kept(best)
        if best:
            q, s, k = best[0]
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), k.cast(arrow), pa.array(s)], ["_q", key, "score"])

    found = held.mapInArrow(score, f"_q bigint, `{key}` {kind.simpleString()}, score double")
    w = Window.partitionBy("_q").orderBy(F.round("score", 9).desc(), key)
    top = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    of_number = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"_q bigint, qid {queries.schema['qid'].dataType.simpleString()}"))
    return top.join(of_number, "_q").select("qid", key, "score", "rank")
