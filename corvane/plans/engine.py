"""The engine: an index over a repository or a table of files, and the queries on it."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import CorvaneError, one_of, query_text
from ..functions import text as X
from ..operators import bm25, chunking, delta, graph, grep, outline, pack, probe
from ..session import cut, scratch, ship, spread
from ..sources import files as sources
from ..sources.store import Store
from . import render


class Engine:
    """``files`` has ``path, mtime, content``; paths are relative to the root. ``store`` keeps the index. Where the files are of several
    projects, ``root_of`` gives the folder of each path's project, in which its imports are looked for. ``count`` is a tokenizer for budgets in place of the estimate."""

    def __init__(self, spark: SparkSession, files: DataFrame, store: str, root: str = "repository", folder: str | None = None, root_of: Column | None = None, count: Callable[[str], int] | None = None):
        self.root_of, self.count = root_of, count
        self.spark, self.files, self.store, self.root, self.folder = ship(spark), files.select("path", "mtime", "content"), Store(spark, store), root, folder
        # what there is, and the contents of some of it
        self.listed = self.files.filter(F.col("content").isNotNull()).select("path", "mtime")
        self.contents = lambda listed: self.files.filter(F.col("content").isNotNull()).join(listed.select("path"), "path", "left_semi")

    @classmethod
    def over(cls, spark: SparkSession, folder: str, store: str) -> Engine:
        listed = sources.source_files(spark, folder)
        e = cls(spark, sources.read_files(listed, folder), store, folder.rstrip("/").rpartition("/")[2], folder.rstrip("/"))
        e.listed, e.contents = listed, lambda some: sources.read_files(some, folder).select("path", "mtime", "content")
        return e

    # index
    def index(self, force: bool = False) -> dict:
        """Brings the index up to date and says how: rebuilt, updated or up_to_date, and the number of new chunks.

        An update chunks, tokenises and writes what changed; of the rest it compares times, and resolves
        imports anew from those stored, since a new file may be what an old one imports.
        """
        if force:
            self.store.purge()
        with scratch(self.spark):
            if not self.store.current():
                return {"status": "rebuilt", "chunks": self._write(None)}
            plan = cut(delta.plan(self.listed, self.store.read("seen")))
            counts = {r[0]: r[1] for r in plan.groupBy("action").count().collect()}
            if not counts.keys() - {"keep"}:
                return {"status": "up_to_date", "chunks": 0}
            replaced = counts.get("modify", 0) + counts.get("remove", 0)
            if self.store.crowded(replaced, sum(counts.values())):
                return {"status": "updated", "chunks": self._write(None, plan)}
            return {"status": "updated", "chunks": self._write(plan)}

    def _write(self, plan: DataFrame | None, of: DataFrame | None = None) -> int:
        """A generation of what ``plan`` says has changed, or of everything; the number of new chunks (of those changed by ``of``)."""
        whole = plan is None
        seen = self.listed if whole else self.listed.join(delta.touched(plan, "add", "modify"), "path", "left_semi")
        changed = cut(self.contents(seen))
        dealt = spread(changed)
        chunked = chunking.indexed(chunking.chunk_definitions(dealt.select("path", "content")))
        gone = {} if whole else {"removed": delta.touched(plan, "modify", "remove")}
        # these wait for nothing but each other's jobs
        with ThreadPoolExecutor(4) as pool:
            chunked = pool.submit(cut, chunked.withColumn("tokens", X.code_tokens(bm25.documents(chunked))))
            imports = pool.submit(cut, graph.syntax_imports(dealt).distinct())
            aliases = pool.submit(self._aliases)
            if not whole:
                old = pool.submit(lambda: cut(self.store.read("chunks").join(gone["removed"].withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(F.col("id").alias("chunk_id"), "dl")))
        chunked, imports, aliases = chunked.result(), imports.result(), aliases.result()
        posting = chunked.select(F.explode("tokens").alias("term"), F.col("id").alias("chunk_id"), F.size("tokens").alias("dl"))
        new = chunked.withColumn("dl", F.size("tokens")).drop("tokens")
        size_of = lambda df: df.agg(F.count_if(F.col("dl") > 0).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
        counted, links = size_of(new), imports
        if not whole:
            lost = size_of(old.result())
            every = self.store.read("stats").select("n", "total").unionByName(counted).unionByName(lost.select((-F.col("n")).alias("n"), (-F.col("total")).alias("total")))
            counted = every.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            links = self.store.read("imports").join(gone["removed"].withColumnRenamed("path", "src"), "src", "left_anti").unionByName(imports)
            gone["removed_chunks"] = old.result().select("chunk_id")
        edges = graph.resolve(self.listed.select("path"), self.root_of, aliases=aliases, imports=links)
        size = changed.agg(F.sum(F.length("content"))).first()[0] or 0 if whole else 0
        self.store.write(whole=whole, size=size, stats=counted, seen=seen.select("path", "mtime"), files=changed, chunks=new, postings=posting, trigrams=grep.postings(dealt), imports=imports, edges=edges, **gone)
        return new.count() if of is None else new.join(delta.touched(of, "add", "modify").withColumnRenamed("path", "file_path"), "file_path", "left_semi").count()

    def _aliases(self) -> DataFrame | None:
        """The path aliases that the settings at the root name."""
        settings = self.contents(self.listed.filter(F.col("path").isin("tsconfig.json", "jsconfig.json")))
        found = sources.aliases(settings)
        return None if found.isEmpty() else found

    def statistics(self) -> tuple[int, float]:
        n, total = self.store.read("stats").select("n", "total").first()
        return n, total / n if n else 1.0

    def forget_imports(self) -> None:
        """Imports are read from the files again with the next index."""
        self.store.purge()

    def chunks(self) -> DataFrame:
        if not self.store.current():
            self.index()
        return self.store.read("chunks").drop("dl")

    def info(self) -> dict:
        n = self.chunks().agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files")).first()
        grams = self.store.read("trigrams").select("trigram").distinct().count()
        return {**n.asDict(), "trigrams": grams}

    # search
    def search(self, query: str, limit: int = 10, min_score: float | None = None) -> DataFrame:
        """The best chunks over the stored postings; ``min_score`` applies after the limit."""
        words = bm25.query_tokens(self.files, query_text(query))
        chunks = self.chunks()
        if not words:
            return chunks.limit(0).withColumn("score", F.lit(0.0))
        mine = self.store.of("postings", words)
        n, average = self.statistics()
        queries = self.spark.createDataFrame([("q", w) for w in words], "qid string, term string")
        best = bm25.search_many(mine, n, average, queries, "chunk_id", limit)
        base = bm25.DELTA * sum(r[0] for r in bm25.terms(mine, n).select("idf").collect())
        found = chunks.join(F.broadcast(best.withColumnRenamed("chunk_id", "id").select("id", (F.col("score") + base).alias("score"))), "id")
        ordered = found.orderBy(F.col("score").desc(), "file_path", "start_line")
        return ordered.filter(F.col("score") >= min_score) if min_score is not None else ordered

    def _many(self, queries: DataFrame, limit: int) -> DataFrame:
        """Several queries (``qid, term``) over the stored postings of their terms."""
        queries = cut(queries)
        words = [r[0] for r in queries.select("term").distinct().collect()]
        return bm25.search_many(self.store.of("postings", words), *self.statistics(), queries, "chunk_id", limit)

    def grep(self, pattern: str, regex: bool = False, limit: int | None = 20, per_file: int | None = grep.PER_FILE) -> DataFrame:
        self.chunks()
        literals = X.regex_literals(pattern) if regex and _valid(pattern) else [pattern]
        wanted = grep.grams(literals)
        posting = self.store.of("trigrams", wanted) if wanted else None
        return (grep.grep_regex if regex else grep.grep_literal)(self.store.read("files"), pattern, limit, posting, per_file=per_file)

    def find(self, query: str, most: int = 5) -> tuple[DataFrame, int]:
        """The best places for a query, and how many were looked at: twice as many as are wanted."""
        met = cut(self.search(query, most * 2))
        return met.orderBy(F.col("score").desc(), "file_path", "start_line").limit(most), met.count()

    # graph
    def edges(self) -> DataFrame:
        self.chunks()
        return self.store.read("edges")

    def inside(self, path: str) -> str:
        """``path`` relative to the root; one that leads out of it is refused."""
        plain = posixpath.normpath(path)
        if plain.startswith("/"):
            if not self.folder or not plain.startswith(self.folder + "/"):
                raise CorvaneError("INVALID_PATH", "the path is outside of the root", path=path)
            plain = plain[len(self.folder) + 1 :]
        if plain.startswith("../") or plain == "..":
            raise CorvaneError("INVALID_PATH", "the path is outside of the root", path=path)
        return plain

    def _start(self, path: str) -> DataFrame:
        if self.store.read("files").filter(F.col("path") == path).isEmpty():
            raise CorvaneError("FILE_NOT_FOUND", "no such file", "paths are relative to the root", path=path)
        return self.spark.createDataFrame([(path,)], "node string")

    def dependencies(self, path: str, depth: int = 3) -> DataFrame:
        return graph.reach(self.edges(), self._start(path), depth)

    def discover(self, path: str) -> DataFrame:
        """``path, imports, imported_by``: what a file reaches in two hops, and of these who imports whom."""
        return graph.neighbourhood(self.edges(), self._start(path))

    def related(self, path: str, most: int = 5) -> DataFrame:
        """Up to ``most`` chunks that the file's name finds, outside of what it reaches."""
        stem = re.sub(r"\.[^./]*$", "", path.rpartition("/")[2])
        met = graph.reach(self.edges(), self._start(path), 2)
        near = self.search(stem, most + 10).join(met.select(F.col("node").alias("file_path")), "file_path", "left_anti")
        return near.orderBy(F.col("score").desc(), "file_path", "start_line").limit(most)

    def explain(self, path: str, function: str | None = None, most: int = 1_000) -> dict:
        """A function, or the whole file, with at most ``most`` of what it imports and of what imports it."""
        edges = self.edges()
        self._start(path)
        own = self.chunks().filter(F.col("file_path") == path)
        target = own.filter(F.lower("name") == function.lower()).orderBy("start_line").limit(1).collect() if function else []
        related = []
        if function:
            stem = re.sub(r"\.[^./]*$", "", path.rpartition("/")[2])
            related = [r.asDict() for r in self.search(f"{function} {stem}", 8).filter(F.col("file_path") != path).limit(3).collect()]
        content = target[0]["content"] if target else self.store.read("files", F.col("path") == path).first()["content"]
        return {
            "path": path, "name": target[0]["name"] if target else "", "start_line": target[0]["start_line"] if target else 1, "end_line": target[0]["end_line"] if target else content.count("\n") + 1,
            "content": content, "related": related,
            "imports": [r[0] for r in edges.filter(F.col("src") == path).orderBy("ord").limit(most).select("dst").collect()],
            "importers": [r[0] for r in graph.importers(edges).filter(F.col("dst") == path).orderBy("src").limit(most).select("src").collect()],
        }

    def impact(self, path: str, depth: int = 3, fuzzy: bool = True, function: str | None = None) -> DataFrame:
        """What a change of ``path`` may touch; ``fuzzy`` adds files that its first five symbols, or ``function``, find."""
        start, near = self._start(path), None
        if fuzzy:
            w = Window.partitionBy(F.lit(0)).orderBy("start_line")
            own = self.chunks().filter((F.col("file_path") == path) & (F.length("name") > 4)).withColumn("n", F.row_number().over(w)).filter("n <= 5")
            names = [function] if function else [r[0] for r in own.select("name").collect()]
            if names:
                q = self.spark.createDataFrame([(s,) for s in names], "qid string").select("qid", F.explode(X.code_tokens(F.col("qid"))).alias("term"))
                hits = self._many(q, 20)
                near = self.chunks().join(F.broadcast(hits.select(F.col("chunk_id").alias("id")).distinct()), "id", "left_semi").select(F.col("file_path").alias("node")).distinct()
        return graph.impact(self.edges(), start, depth, near)

    # packing
    def pack(self, focus: str | None = None, query: str | None = None, *, max_files: int = 10, max_chunks: int = 20, max_tokens: int | None = None, min_score: float | None = None, import_depth: int = 1, offset: int = 0, chunk_mode: bool = False, skeleton: bool = False, focus_only: bool = False) -> dict:
        query = None if focus_only else query
        one_of(focus, query)
        focus = self.inside(focus) if focus else None
        files = self.store.read("files") if self.chunks() is not None else None
        taken, used, reason, available = [], 0, None, 0
        w = Window.partitionBy(F.lit(0)).orderBy("rank")
        if focus:
            first = self._start(focus).select(F.col("node").alias("path"), F.lit(0).alias("depth"))
            deps = graph.reach(self.edges(), self._start(focus), import_depth).filter("depth > 0").select(F.col("node").alias("path"), "depth")
            ranked = first.unionByName(deps).join(files, "path").withColumn("rank", F.struct("depth", "path"))
            body = X.token_count(F.col("content"), self.count)
            within = cut(pack.file_budget(ranked, body, max_tokens).withColumn("n", F.row_number().over(w)))
            available = deps.count() + 1
            kept = within.filter(F.col("n") <= max_files).orderBy("n").collect()
            reason = "max_files" if within.count() > max_files else "token_budget" if len(kept) < available else None
            for r in kept:
                shown = outline.skeleton_of(r["path"], r["content"]) if skeleton and r["path"] != focus else r["content"]
                taken.append({"path": r["path"], "content": shown, "reason": "focus file" if r["path"] == focus else "import", "score": None})
            used = sum(map(self._cost, taken))
        chunks: list[dict] = []
        if query and (max_tokens is None or used < max_tokens):
            limit = max_chunks if chunk_mode else max_files
            hits = self.search(query, (offset + limit) * pack.FETCHED)
            by = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "file_path", "start_line")
            hits = cut(hits.withColumn("rank", F.row_number().over(by)).withColumn("path", F.col("file_path")))
            available += hits.count()
            whole = self.spark.createDataFrame([(f["path"],) for f in taken], "path string")
            rows = pack.covered(pack.page(hits, limit, offset, min_score), whole)
            if chunk_mode:
                once = rows.withColumn("n", F.row_number().over(Window.partitionBy("path", "start_line", "end_line").orderBy("rank"))).filter("n = 1").drop("n")
                inside = cut(pack.chunk_budget(once, X.token_count(F.col("content"), self.count), max_tokens, used))
                cutoff = pack.at_most(inside, max_chunks)
                reason = "max_chunks" if inside.count() > max_chunks else "token_budget" if inside.count() < once.count() else reason
                merged = pack.merge(cutoff.withColumn("reason", F.format_string("match (score: %.2f)", "score")), files)
                chunks = [r.asDict() for r in merged.orderBy("path", "start_line").collect()]
            else:
                best = rows.groupBy("path").agg(F.min("rank").alias("rank"), F.max("score").alias("score"), F.min_by("name", "rank").alias("name"))
                room = pack.file_budget(best.join(files, "path"), X.token_count(F.col("content"), self.count), max_tokens, used)
                inside = cut(room)
                cutoff = pack.at_most(inside, max(0, max_files - len(taken)))
                reason = "max_files" if inside.count() > max_files - len(taken) else "token_budget" if inside.count() < best.count() else reason
                # what the query found of a file stays whole: the definitions of that name, and those its lines lie in
                places = rows.groupBy("path").agg(F.collect_set("name").alias("names"), F.flatten(F.collect_set(F.sequence("start_line", "end_line"))).alias("lines"))
                for r in cutoff.join(places, "path").orderBy("rank").collect():
                    shown = outline.skeleton_of(r["path"], r["content"], frozenset(n for n in r["names"] if n), frozenset(r["lines"])) if skeleton else r["content"]
                    taken.append({"path": r["path"], "content": shown, "reason": f"match: {r['name'] or 'chunk'}", "score": r["score"]})
        sized = [(f["content"].count("\n") + 1, len(f["content"]), self._cost(f)) for f in [*taken, *chunks]]
        table = self.spark.createDataFrame(sized, "lines int, chars int, tokens int")
        row = pack.summary(table, available, max_chunks if chunk_mode else max_files, offset, reason, max_tokens, "chunks" if chunk_mode else "files").first().asDict()
        return {"files": taken, "chunks": chunks, "summary": row}

    def _cost(self, taken: dict) -> int:
        text = taken["content"]
        return (-(-len(text) // 4) if self.count is None else self.count(text)) + X.FRAME

    def audit(self, **how) -> list[dict]:
        """What a pack costs, file by file, without its text: the dearest first."""
        packed = self.pack(**{**how, "chunk_mode": False})
        rows = self.spark.createDataFrame([(f["path"], f["content"], f["reason"]) for f in packed["files"]], "path string, content string, reason string")
        costs = {r["path"]: r.asDict() for r in pack.audit(rows, count=self.count).collect()}
        return sorted(({**costs[f["path"]], "reason": f["reason"]} for f in packed["files"]), key=lambda r: (-r["tokens"], r["path"]))

    # symbols and maps
    def probe(self, text: str, limit: int = 10) -> dict:
        """Symbols that ``text`` uses and doesn't define, how many these are, the chunk that defines each of the first ``limit`` best, and what the text defines."""
        one = self.spark.createDataFrame([(text,)], "content string").withColumn("k", F.lit(0))
        every = [r[0] for r in probe.symbols(one, "k").select("symbol").orderBy("symbol").collect()]
        defined = [r[0] for r in one.select(F.explode(F.array_sort(X.definitions(F.col("content"))))).limit(20).collect()]
        wanted = every[:limit]
        if not wanted:
            return {"count": 0, "missing": [], "defined": defined}
        self.chunks()
        asked = probe.questions(self.spark.createDataFrame([(w,) for w in wanted], "symbol string"))
        hits = cut(self._many(asked, 1).select(F.col("qid").alias("symbol"), F.col("chunk_id").alias("id"), "score"))
        at = {r["symbol"]: r for r in self.chunks().join(F.broadcast(hits), "id").collect()}
        missing = [{"symbol": s, "file": at[s]["file_path"] if s in at else None, "name": at[s]["name"] if s in at else None, "line": at[s]["start_line"] if s in at else None, "suggestion": f"pack focus={at[s]['file_path']}" if s in at else f"search {s} definition"} for s in wanted]
        return {"count": len(every), "missing": missing, "defined": defined}

    def map_lines(self, most: int | None = 10) -> DataFrame:
        """``path, at, line``: signatures of all files, as a table of any size."""
        return outline.shown(outline.signatures(self.files), most)

    def map(self, form: str = "tree", signatures: bool = True, most: int | None = 10, files: int = 20_000) -> str:
        """The folders and files, the first ``files`` of them by path, as a text; ``map_lines`` has all."""
        paths = cut(self.listed.select("path").orderBy("path").limit(files + 1))
        held = [r[0] for r in paths.orderBy("path").collect()]
        shown_paths = self.spark.createDataFrame([(p,) for p in held[:files]], "path string")
        nodes = [r.asDict() for r in sources.tree(shown_paths).collect()]
        shown: dict[str, list[str]] = {}
        if signatures:
            few = self.contents(self.listed.join(F.broadcast(shown_paths), "path", "left_semi"))
            for r in outline.shown(outline.signatures(few), most).orderBy("path", "at").collect():
                shown.setdefault(r["path"], []).append(r["line"])
        rest = f"\n... (files beyond the first {files} by path)" if len(held) > files else ""
        if form == "flat":
            return "\n".join(line for n in sorted((n for n in nodes if n["is_file"]), key=lambda n: n["path"]) for line in [n["path"], *(f"  {s}" for s in shown.get(n["path"], []))]) + rest
        return render.tree(nodes, shown, self.root) + rest


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False
