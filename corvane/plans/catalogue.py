"""Queries over the driver's tables, one per operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import bm25, chunking, delta, graph, grep, outline, pack, probe
from ..session import leave_no_trace, shared_dir, spread
from ..sources import files as sources
from ..streaming import watch
from . import sql
from .engine import Engine

QUERY = "the token budget of a rejected harbor sampler"
PHRASE = "token budget"
#: Settings with two aliases that fit relative imports, one of them with two targets.
SETTINGS = '{"compilerOptions": {"baseUrl": "elsewhere", "paths": {"./*": ["a/*", "b/*"], "./m*": ["c/*"]}}} // end'
LITERAL, OVERLAPPING, PATTERN, SHORT = "return nil", "  ", r"raise (\w+)Error\(", "=>"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Files as delivered, some of them twice. Where results are small, those are made distinct, and no content is moved."""
    return _t(spark, sf, "files").select("path", "repo", "mtime", "length", "content")


def files(spark: SparkSession, sf: str, where=None) -> DataFrame:
    """Files once each, as the engine's tables have them; ``where`` is applied before that, in the scan."""
    rows = scanned(spark, sf)
    return (rows.filter(where) if where is not None else rows).dropDuplicates(["path"])


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return collected(spark, sf).dropDuplicates(["id"])


def collected(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as delivered."""
    c = _t(spark, sf, "chunks")
    return c.select("id", "file_path", F.coalesce("content", F.lit("")).alias("content"), "start_line", "end_line", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("node_type", F.lit("")).alias("node_type"), "last_modified")


def raw(text):
    """Tokens that any SQL can restate: lower-case ASCII words."""
    return F.array_distinct(F.filter(F.transform(X.raw_tokens(text), F.lower), lambda t: F.length(t) > 1))


# tokens and scalar functions
def tokenize_raw(s, d):
    return _t(s, d, "documents").select("doc_id", F.explode(raw(F.col("text"))).alias("token"))


def tokenize_parts(s, d):
    both = lambda r: F.array_distinct(F.filter(F.concat(X._parts(r, "_"), X._parts(r, ".")), lambda t: F.length(t) > 1))
    return files(s, d).select("path", F.explode(both(F.transform(X.raw_tokens(F.col("path")), F.lower))).alias("token"))


def tokenize_affix(s, d):
    return chunks(s, d).filter("name <> ''").select(F.explode(raw(F.col("name"))).alias("token")).distinct().select("token", F.explode(F.array_distinct(X.affix_roots(F.array("token")))).alias("root"))


def code_tokens(s, d):
    return spread(collected(s, d)).select("id", F.explode(X.code_tokens(F.col("content"))).alias("token")).distinct()


def content_dedup(s, d):
    f = scanned(s, d).filter("content is not null").select("path", X.content_hash(F.col("content")).alias("content_hash")).distinct()
    return f.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))


def chunk_ids(s, d):
    return _t(s, d, "chunks").select("file_path", "start_line", "end_line").distinct().withColumn("chunk_id", X.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line")))


def repo_hashes(s, d):
    return _t(s, d, "repos").select("repo", X.repo_hash(F.col("repo")).alias("repo_hash"))


def text_filter(s, d):
    inside = F.regexp_replace("path", "^[^/]*/", "")
    bytes_ = F.octet_length("content")
    return scanned(s, d).filter(sources.sized(bytes_) & ~sources.excluded(inside)).select("path", bytes_.alias("bytes")).distinct()


def ext_language(s, d):
    return files(s, d).groupBy(X.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


def token_estimates(s, d):
    return _t(s, d, "documents").filter("text is not null").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def previews(s, d):
    return _t(s, d, "documents").filter("text is not null").select("doc_id", X.preview(F.col("text"), 60).alias("preview"), X.escape_xml(F.col("text"), True).alias("escaped"))


# chunks
def chunk_fallback(s, d):
    return chunking.chunk_lines(_t(s, d, "documents"), "doc_id", "text")


def ast_chunks(s, d):
    return chunking.chunk_definitions(files(s, d)).select("path", "start_line", "end_line", "type", "name", "is_anchor", "content")


def chunk_neighbours(s, d):
    f = files(s, d)
    return chunking.neighbours(chunking.chunk_definitions(f), f).select("path", "start_line", "end_line", "type", "content", "context_prev", "context_next")


# ranking
def _docs(s, d):
    return _t(s, d, "documents").filter("text is not null").select("doc_id", "text")


def doc_stats(s, d):
    return _docs(s, d).select(F.size(raw(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").alias("longest"))


def term_df(s, d):
    return bm25.terms(bm25.postings(_docs(s, d), "doc_id", raw(F.col("text"))), _docs(s, d).count()).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_all_scores(s, d):
    return bm25.score_all(_docs(s, d), raw(F.col("text")), bm25.query_tokens(_docs(s, d), QUERY, raw), keep=["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


def bm25_no_overlap(s, d):
    return bm25.score_all(_docs(s, d), raw(F.col("text")), bm25.query_tokens(_docs(s, d), "orchard granary", raw), require_overlap=False, keep=["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


def _ranked(s, d):
    return bm25_all_scores(s, d).orderBy(F.col("score").desc(), "doc_id")


def bm25_topk(s, d):
    return _ranked(s, d).limit(10)


def bm25_min_score_after_limit(s, d):
    return _ranked(s, d).limit(10).filter("score >= 12")


def search_chunks(s, d):
    return bm25.search(collected(s, d), QUERY, 10).select("id", "file_path", "start_line", "end_line", "name", F.round("score", 6).alias("score"))


def bm25_batch(s, d):
    q = _t(s, d, "eval_items").filter("text is not null").select(F.col("item_id").alias("qid"), F.explode(raw(F.col("text"))).alias("term"))
    return bm25.search_corpus(_docs(s, d), "doc_id", raw(F.col("text")), q, 3).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


# exact search
def trigram_stats(s, d):
    p = grep.postings(files(s, d))
    return grep.stats(files(s, d), p)


def document_trigrams(s, d):
    return spread(_docs(s, d)).select(F.explode(X.trigrams(F.col("text"))).alias("trigram")).groupBy("trigram").agg(F.count("*").alias("documents"))


def trigram_candidates(s, d):
    return grep.candidates(_t(s, d, "trigrams"), grep.grams([LITERAL]), "file_id")


def _having(s, d, literal):
    return files(s, d, F.contains("content", F.lit(literal)))


def grep_literal(s, d):
    return grep.grep_literal(_having(s, d, LITERAL), LITERAL, None).select("file", "line", "match")


def grep_overlapping(s, d):
    hits = _docs(s, d).filter(F.contains("text", F.lit(OVERLAPPING))).select("doc_id", F.posexplode(grep._positions(F.col("text"), OVERLAPPING)).alias("n", "line"))
    return hits.select("doc_id", "n", "line")


def grep_context(s, d):
    return grep.grep_literal(_having(s, d, LITERAL), LITERAL, None).select("file", "line", "context")


def grep_indexed(s, d):
    f = files(s, d)
    return grep.grep_literal(f, LITERAL, None, grep.postings(f)).select("file", "line", "match")


def grep_regex(s, d):
    return grep.grep_regex(_having(s, d, "raise "), PATTERN, None).select("file", "line", "match")


def grep_ignore_case(s, d):
    return grep.grep_regex(files(s, d), r"(?i)RAISE \w+", None, per_file=None).groupBy("file").agg(F.count("*").alias("hits"))


def grep_no_literal(s, d):
    return grep.grep_regex(files(s, d), r"\w+\(\d\)", None).select("file", "line", "match")


def grep_short_pattern_cap(s, d):
    return grep.grep_literal(files(s, d), SHORT, 20, unfiltered=100).select("file", "line", "match")


# maintenance
def delta_plan(s, d):
    seen = _t(s, d, "snapshots")
    latest = seen.groupBy("path").agg(F.max_by(F.struct("old_mtime", "new_mtime"), F.struct("observed_at", "new_mtime", "old_mtime")).alias("m")).select("path", "m.*")
    current = latest.filter("new_mtime is not null").select("path", F.col("new_mtime").alias("mtime"))
    stored = latest.filter("old_mtime is not null").select("path", F.col("old_mtime").alias("mtime"))
    return delta.plan(current, stored)


def delta_apply(s, d):
    plan = delta_plan(s, d)
    kept = delta.apply(chunks(s, d), plan, chunks(s, d).limit(0))
    return kept.groupBy("file_path").agg(F.count("*").alias("chunks"))


def upsert(s, d):
    f = _t(s, d, "files").select("path", "mtime").dropDuplicates(["path"])
    new = _t(s, d, "snapshots").groupBy("path").agg(F.max("new_mtime").alias("mtime")).filter("mtime is not null")
    return delta.upsert(f, new, "path")


# graph
def _edges(s, d):
    return _t(s, d, "edges")


def raw_imports(s, d):
    return graph.raw_imports(scanned(s, d)).select("src", "language", "import").distinct()


def resolve_imports(s, d):
    return graph.resolve(scanned(s, d), F.col("repo")).select("src", "dst", "ord")


def resolve_pairs(s, d):
    return resolve_imports(s, d).select("src", "dst")


def dep_bfs(s, d):
    e = _edges(s, d)
    roots = e.select(F.col("src").alias("node")).distinct().join(e.filter("dst is not null").select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return graph.reach(e, roots, 3)


def _busiest(s, d):
    return graph.importers(_edges(s, d)).groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dst").limit(1).select(F.col("dst").alias("node"))


def impact_reverse(s, d):
    return graph.impact(_edges(s, d), _busiest(s, d), 3)


def importers(s, d):
    return graph.importers(_edges(s, d)).groupBy("dst").agg(F.count("*").alias("importers"), F.min("src").alias("first"))


def alias_targets(s, d):
    """Where imports lead that an alias fits, in order of trial."""
    settings = s.createDataFrame([(SETTINGS,)], "content string")
    imports = graph.raw_imports(scanned(s, d)).filter(F.col("language").isin("typescript", "javascript")).select("src", "language", "import").distinct().withColumn("ord", F.lit(0))
    return graph.bases(imports, sources.aliases(settings)).select("src", "import", F.posexplode("bases").alias("nth", "base")).filter(F.startswith("base", F.lit("elsewhere")))


# packing of results
def _hits(s, d):
    c = collected(s, d)
    best = bm25.score_all(c, raw(bm25.documents(c)), bm25.query_tokens(c, QUERY, raw), keep=["id", "file_path", "start_line"], once="id").withColumn("score", F.round("score", 6))
    w = Window.orderBy(F.col("score").desc(), "file_path", "start_line", "id")
    top = best.orderBy(F.col("score").desc(), "file_path", "start_line", "id").limit(60).withColumn("rank", F.row_number().over(w)).select("id", "score", "rank")
    return c.join(F.broadcast(top), "id").dropDuplicates(["id"]).withColumns({"path": F.col("file_path"), "reason": F.lit("match")})


def merge_chunks(s, d):
    c = chunks(s, d).filter("start_line is not null and end_line is not null").select(F.col("file_path").alias("path"), "start_line", "end_line")
    return pack.islands(c).groupBy("path", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("parts")).drop("island")


def pack_chunk_budget(s, d):
    return pack.chunk_budget(_hits(s, d), X.token_estimate(F.col("content")), 3000).select("rank", "id", "total")


def pack_file_budget(s, d):
    return pack.file_budget(_hits(s, d), X.token_estimate(F.col("content")), 3000).select("rank", "id", "total")


def pack_page(s, d):
    return pack.at_most(pack.page(_hits(s, d), 10, 5, 5.0), 10).select("rank", "id", "score")


def pack_merged(s, d):
    return pack.merge(pack.at_most(_hits(s, d), 20), files(s, d)).select("path", "start_line", "end_line", "name", "score", "parts")


def pack_summary(s, d):
    kept = pack.at_most(_hits(s, d), 20).select((F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.length("content").alias("chars"), X.token_estimate(F.col("content")).alias("tokens"))
    return pack.summary(kept, 60, 20, 0, "max_chunks").select("returned", "total_lines", "total_chars", "total_tokens", "truncated", "total_available", "has_more", "next_offset")


def pack_budget_per_file(s, d):
    """The budget within every file at once, in order of lines."""
    c = collected(s, d).select("file_path", "id", F.struct("start_line", "id").alias("rank"), X.token_estimate(F.col("content")).alias("cost")).dropDuplicates(["id"])
    return pack.chunk_budget(c, F.col("cost"), 1000, keys=("file_path",)).select("file_path", "id", "total")


def audit_tiers(s, d):
    f = scanned(s, d).filter("content is not null").distinct()
    return pack.audit(f, keys=("repo",)).select("repo", "path", "tokens", "total", "advice")


def coverage(s, d):
    whole = _busiest(s, d).withColumnRenamed("node", "path")
    return pack.covered(chunks(s, d).withColumnRenamed("file_path", "path"), whole).groupBy("path").agg(F.count("*").alias("chunks"))


# symbols, maps
def symbols_missing(s, d):
    return probe.symbols(spread(scanned(s, d)).filter("content is not null"), "path").distinct()


def symbols_defined(s, d):
    return scanned(s, d).filter("content is not null").select("path", F.explode(X.definitions(F.col("content"))).alias("symbol")).distinct()


def probe_best(s, d):
    common = symbols_missing(s, d).groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "symbol").limit(20)
    found = probe.best(collected(s, d), [r[0] for r in common.collect()])
    return found.select("symbol", "id", F.round("score", 6).alias("score"))


def map_tree(s, d):
    return sources.tree(files(s, d).select("path"))


def repo_map(s, d):
    return outline.shown(outline.signatures(scanned(s, d)).dropDuplicates(["path"]), 10)


def map_go(s, d):
    """The signatures of Go files, which SQL can tell by their lines."""
    go = scanned(s, d).filter(F.col("path").endswith(".go") & F.col("content").isNotNull()).dropDuplicates(["path"])
    return outline.signatures(go).select("path", F.posexplode("sigs").alias("nth", "sig")).select("path", "nth", F.col("sig.text").alias("signature"))


def skeletonize(s, d):
    return outline.skeletonize(files(s, d).filter("content is not null"))


# events
def debounce_sessions(s, d):
    e = _t(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    g = watch.debounced(e, "user_id", "10 minutes")
    return g.select("user_id", "events", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


def debounce_all(s, d):
    """Bursts of the whole feed."""
    e = _t(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return watch.debounced(e, None, "1 minute").select("events", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


# the engine: its index is built once for all of these
def _indexed(s, d, name, table, root_of=None):
    at = f"{shared_dir(s).rstrip('/')}/corvane-{s.sparkContext.applicationId}-{name}-{abs(hash(d))}"
    e = Engine(s, table, at, root_of=root_of)
    if not e.store.current():
        e.index()
        leave_no_trace(s, at)
    return e


def texts(s, d):
    """The engine over the documents, as files."""
    t = _t(s, d, "documents").filter("text is not null")
    return _indexed(s, d, "texts", t.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(0.0).alias("mtime"), F.col("text").alias("content")))


def code(s, d):
    """The engine over the files of all repositories."""
    return _indexed(s, d, "code", files(s, d).select("path", F.coalesce("mtime", F.lit(0.0)).alias("mtime"), "content"), F.split("path", "/")[0])


def engine_search(s, d):
    return texts(s, d).search(QUERY, 10).select("file_path", "start_line", "end_line", F.round("score", 6).alias("score"))


def engine_find(s, d):
    found, total = texts(s, d).find(QUERY, 5)
    return found.select("file_path", "start_line", F.round("score", 6).alias("score"), F.lit(total).alias("total"))


def engine_grep(s, d):
    return texts(s, d).grep(PHRASE, limit=None).select("file", "line", "match")


def engine_grep_regex(s, d):
    return texts(s, d).grep(r"(?i)TOKEN BUDGET", True, None, None).groupBy("file").agg(F.count("*").alias("hits"))


def index_info(s, d):
    i = texts(s, d).info()
    return s.createDataFrame([(i["chunks"], i["files"], i["trigrams"])], "chunks bigint, files bigint, trigrams bigint")


def engine_pack(s, d):
    p = texts(s, d).pack(query=QUERY, max_files=5)
    return s.createDataFrame([(n, f["path"], f["content"]) for n, f in enumerate(p["files"], 1)], "rank int, path string, content string")


def engine_pack_chunks(s, d):
    p = texts(s, d).pack(query=QUERY, max_chunks=8, max_tokens=4000, chunk_mode=True)
    return s.createDataFrame([(c["path"], c["start_line"], c["end_line"], round(c["score"], 6)) for c in p["chunks"]], "path string, start_line int, end_line int, score double")


def engine_audit(s, d):
    rows = texts(s, d).audit(query=QUERY, max_files=5)
    return s.createDataFrame([(r["path"], r["tokens"], r["lines"], r["total"], r["advice"]) for r in rows], "path string, tokens bigint, lines int, total bigint, advice string")


def engine_edges(s, d):
    return code(s, d).edges().select("src", "dst", "ord")


def _start_of(e, column):
    """The file with most imports (src), or the one that most import (dst); none where no import leads to a file."""
    most = e.edges().groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).first()
    return most and most[0]


def discover(s, d):
    """What a file reaches in two hops, and which of these import each other."""
    e = code(s, d)
    start = _start_of(e, "src")
    if start is None:
        return s.createDataFrame([], "path string, depth int, imports string, imported_by string")
    return e.discover(start).select("path", "depth", F.concat_ws(",", "imports").alias("imports"), F.concat_ws(",", "imported_by").alias("imported_by"))


def engine_impact(s, d, fuzzy=False):
    e = code(s, d)
    start = _start_of(e, "dst")
    return s.createDataFrame([], "path string, depth int, kind string") if start is None else e.impact(start, 3, fuzzy=fuzzy)


def engine_impact_fuzzy(s, d):
    return engine_impact(s, d, True)


def engine_explain(s, d):
    e = code(s, d)
    start = _start_of(e, "dst")
    x = e.explain(start) if start else {"imports": [], "importers": []}
    return s.createDataFrame([(k, p) for k in ("imports", "importers") for p in x[k]], "kind string, path string")


def engine_probe(s, d):
    """What a file uses and doesn't define."""
    e = code(s, d)
    start = _start_of(e, "src")
    found = e.probe(e.store.read("files", F.col("path") == start).first()["content"], 1000)["missing"] if start else []
    return s.createDataFrame([(m["symbol"],) for m in found], "symbol string")


# what must hold of results that SQL can't state: each query counts what breaks a rule
def ast_chunks_lines(s, d):
    """Chunks that aren't the lines they say, and lines that two chunks of a file have."""
    c = chunking.chunk_definitions(files(s, d)).filter("not is_anchor").withColumnRenamed("content", "body")
    lines = files(s, d).select("path", F.split("content", "\n", -1).alias("lines"))
    held = c.join(lines, "path").select("path", "start_line", "end_line", (F.col("body") != F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")).alias("wrong"))
    w = Window.partitionBy("path").orderBy("start_line")
    return held.withColumn("twice", F.lag("end_line").over(w) >= F.col("start_line")).agg(F.count_if("wrong").alias("wrong"), F.count_if("twice").alias("twice"))


def neighbours_of_texts(s, d):
    t = _t(s, d, "documents").filter("text is not null").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return chunking.neighbours(chunking.chunk_definitions(t), t).select("path", "start_line", "end_line", "content", "context_prev", "context_next")


def skeleton_lines(s, d):
    """Lines of skeletons that are neither lines of their file nor stand for a body."""
    f = files(s, d).filter("content is not null")
    lines = lambda c: F.transform(F.split(c, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\s{}]+", " ")))
    both = outline.skeletonize(f).join(f.select("path", "content"), "path")
    extra = F.array_except(lines(F.col("skeleton")), lines(F.col("content")))
    marks = F.filter(extra, lambda x: ~x.isin("...", "// ...", ""))
    return both.agg(F.sum(F.size(marks)).alias("extra"), F.count_if(F.length("skeleton") > F.length("content") + 64).alias("longer"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_raw, tokenize_parts, tokenize_affix, code_tokens, content_dedup, chunk_ids, repo_hashes, text_filter, ext_language, token_estimates, previews, chunk_fallback, ast_chunks, chunk_neighbours,
        doc_stats, term_df, bm25_all_scores, bm25_no_overlap, bm25_topk, bm25_min_score_after_limit, search_chunks, bm25_batch, trigram_stats, document_trigrams, trigram_candidates, grep_literal, grep_overlapping,
        grep_context, grep_indexed, grep_regex, grep_short_pattern_cap, delta_plan, delta_apply, upsert, raw_imports, resolve_imports, resolve_pairs, dep_bfs, impact_reverse, importers, alias_targets, merge_chunks,
        pack_chunk_budget, pack_file_budget, pack_page, pack_merged, pack_summary, pack_budget_per_file, audit_tiers, coverage, symbols_missing, symbols_defined, probe_best, map_tree, repo_map, map_go, skeletonize, debounce_sessions, debounce_all,
        grep_ignore_case, grep_no_literal, engine_search, engine_find, engine_grep, engine_grep_regex, index_info, engine_pack, engine_pack_chunks, engine_audit, engine_edges, discover, engine_impact, engine_impact_fuzzy, engine_explain, engine_probe,
        ast_chunks_lines, neighbours_of_texts, skeleton_lines,
    )
}
SQL = sql.SQL
