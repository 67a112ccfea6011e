"""Imports to edges, and traversal of the edges by frontiers."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import cut
from . import braces

# Languages whose imports are resolved, their extensions in order of trial, index files, import
# statements, and modules of Python's library.
LANGUAGES = {"python": "py", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "rust": "rs", "go": "go", "c": "c h", "cpp": "cpp hpp"}
TRIED = {"python": "py", "typescript": "ts tsx js jsx d.ts", "javascript": "js jsx mjs cjs", "rust": "rs", "go": "go", "c": "h c", "cpp": "hpp cpp h"}
INDEX = {"python": ["__init__.py"], "typescript": ["index.ts", "index.tsx", "index.js", "index.jsx"], "javascript": ["index.ts", "index.tsx", "index.js", "index.jsx"], "rust": ["mod.rs"], "go": ["main.go"]}
_QUOTED = r"[\"']([^\"']+)[\"']"
IMPORTS = {
    "python": [r"(?m)^\s*from\s+(\S+)\s+import", r"(?m)^\s*import\s+(\S+)"],
    "typescript": [rf"from\s+{_QUOTED}", rf"import\s+{_QUOTED}", rf"require\s*\(\s*{_QUOTED}\s*\)", rf"import\s*\(\s*{_QUOTED}\s*\)"],
    "javascript": [rf"from\s+{_QUOTED}", rf"import\s+{_QUOTED}", rf"require\s*\(\s*{_QUOTED}\s*\)"],
    "rust": [r"(?m)^\s*use\s+(\S+)", r"(?m)^\s*mod\s+(\S+)"],
    "go": [rf"import\s+{_QUOTED}"],
}
GO_BLOCK = r"(?s)import\s+\(([^)]+)\)"
LIBRARY = (
    "sys os typing __future__ datetime json re pathlib collections functools itertools dataclasses abc enum logging io copy math random time threading multiprocessing subprocess shutil "
    "tempfile hashlib base64 uuid contextlib warnings traceback"
).split()
STRINGS = "array<string>"
#: Nodes of a frontier that are broadcast.
FEW = 100_000


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for name, es in LANGUAGES.items() for e in es.split() for x in (e, name)))
    return table[X.extension(path)]


def raw_imports(files: DataFrame) -> DataFrame:
    """``src, language, ord, import``: what each file names, in the order of patterns and places."""
    lang = language(F.col("path"))
    found = None
    for name, patterns in IMPORTS.items():
        every = F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns)))
        if name == "go":
            inner = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(GO_BLOCK), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(_QUOTED), F.lit(1))))
            every = F.concat(every, inner)
        found = F.when(lang == name, every) if found is None else found.when(lang == name, every)
    rows = files.select(F.col("path").alias("src"), lang.alias("language"), F.posexplode(found).alias("ord", "import"))
    clean = F.regexp_replace(F.trim("import"), "^['\";,]+|['\";,]+$", "")
    return rows.withColumn("import", clean).filter(F.length("import") > 0)


def _python_imports(text: str) -> list[str] | None:
    """What a module's statements name, as its patterns would read it; none if it doesn't parse."""
    try:
        nodes = [n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.Import, ast.ImportFrom))]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    nodes.sort(key=lambda n: (n.lineno, n.col_offset))
    return [x for n in nodes for x in ([a.name for a in n.names] if isinstance(n, ast.Import) else ["." * n.level + (n.module or "")])]


def imports_of(name: str, text: str) -> list[str]:
    """Imports in order: from the syntax tree for Python, else what patterns find outside of comments and strings."""
    if name == "python" and (found := _python_imports(text)) is not None:
        return found
    code = braces.blanked(text, _FAMILY[name]) if name in _FAMILY else text
    met = []
    for k, p in enumerate([*IMPORTS[name], *([GO_BLOCK] if name == "go" else [])]):
        for m in re.finditer(p, text):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if code[at] == text[at]:
                met += [(k, m.start(), x) for x in (re.findall(_QUOTED, m[1]) if p == GO_BLOCK else [m[1]])]
    return [x for _, _, x in sorted(met, key=lambda x: x[:2])]


_FAMILY = {"typescript": "ecma", "javascript": "ecma", "rust": "rust", "go": "go"}


def syntax_imports(files: DataFrame) -> DataFrame:
    """As ``raw_imports``, without what stands in comments, strings and documentation."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for b in batches:
            found = [[i for x in imports_of(name, text) if (i := re.sub("^['\";,]+|['\";,]+$", "", x.strip(" ")))] for name, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind)], ["src", "language", "found"])

    lang = language(F.col("path"))
    rows = files.select(F.col("path").alias("src"), lang.alias("language"), "content").filter(F.col("language").isin(*IMPORTS) & F.col("content").isNotNull())
    return rows.mapInArrow(read, "src string, language string, found array<string>").select("src", "language", F.posexplode("found").alias("ord", "import"))


def normal(path: Column) -> Column:
    """Without ``.`` parts, and with ``..`` applied."""
    def step(a: Column, p: Column) -> Column:
        return F.when((p == ".") | (p == ""), a).when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast(STRINGS), step), "/")


def _folder(path: Column, up: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), "/")


def bases(imports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``imports`` with ``bases``: paths, below each source's root, that an import may stand for, in order of trial.

    ``imports`` may have a ``root``; the sources' paths begin with it. An import that an alias fits is
    joined to its targets, of which there are a few per project.
    """
    rows = imports if "root" in imports.columns else imports.withColumn("root", F.lit(""))
    if aliases is not None:
        fits = F.startswith(F.col("import"), F.col("prefix"))
        few = aliases.limit(10_001).count() <= 10_000
        of_root = ["root"] if "root" in aliases.columns else []
        small = aliases.select(*of_root, "prefix", "target", F.col("ord").alias("alias_ord"))
        small = F.broadcast(small) if few else small
        first = F.substring("import", 1, 1)
        rest = F.substring(F.col("import"), F.length("prefix") + 1, F.lit(1 << 30))
        met = rows.withColumn("_c", first).join(small.withColumn("_c", F.substring("prefix", 1, 1)), ["_c", *of_root]).filter(fits)
        # an import meets the aliases that fit it, a few
        ordered = F.array_sort(F.collect_list(F.struct("alias_ord", F.concat("target", rest).alias("to"))))
        targets = met.groupBy("src", "ord", "import").agg(F.transform(ordered, lambda s: s["to"]).alias("aliased"))
        rows = rows.join(targets, ["src", "ord", "import"], "left")
    else:
        rows = rows.withColumn("aliased", F.lit(None).cast(STRINGS))
    i, lang = F.col("import"), F.col("language")
    dots = F.length(F.regexp_extract(i, r"^(\.*)", 1))
    script = lang.isin("typescript", "javascript")
    python_relative = F.concat_ws("/", _folder(F.col("src"), dots), F.replace(F.substring(i, dots + 1, F.lit(1 << 30)), F.lit("."), F.lit("/")))
    relative = F.when(lang == "python", F.array(python_relative)).otherwise(F.array(F.concat_ws("/", _folder(F.col("src"), F.lit(1)), i)))
    at = F.concat_ws("/", F.nullif("root", F.lit("")), i)
    named = F.regexp_replace(F.substring(i, 2, 1 << 30), "^/+", "")
    scoped = F.when(F.startswith(i, F.lit("@")), F.array(F.concat_ws("/", F.nullif("root", F.lit("")), F.lit("src"), named), F.concat_ws("/", F.nullif("root", F.lit("")), named))).otherwise(F.array().cast(STRINGS))
    dotted = F.replace(i, F.lit("."), F.lit("/"))
    absolute = F.when(lang == "python", F.array(F.concat_ws("/", F.nullif("root", F.lit("")), dotted), F.concat_ws("/", F.nullif("root", F.lit("")), F.lit("src"), dotted))).when(script, F.concat(F.array(at), scoped)).otherwise(F.array(at))
    from_aliases = F.when(script, F.coalesce("aliased", F.array().cast(STRINGS))).otherwise(F.array().cast(STRINGS))
    every = F.when(F.startswith(i, F.lit(".")), F.concat(from_aliases, relative)).when(F.size(from_aliases) > 0, from_aliases).otherwise(absolute)
    outside = F.startswith(i, F.lit("node_modules")) | F.startswith(i, F.lit("http")) | ((lang == "python") & i.isin(LIBRARY))
    return rows.filter(~outside).withColumn("bases", F.transform(every, normal)).drop("aliased")


def candidate_paths(base: Column, lang: Column) -> Column:
    """A base itself, with each extension of its language appended and then put in place of its own, and its index files."""
    made = None
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]*$", "")
    for name, es in TRIED.items():
        added = [F.concat(base, F.lit("." + e)) for e in es.split()]
        put = [F.concat(stem, F.lit("." + e)) for e in es.split()]
        inside = [F.concat(base, F.lit("/" + x)) for x in INDEX.get(name, [])]
        row = F.array(base, *added, *put, *inside)
        made = F.when(lang == name, row) if made is None else made.when(lang == name, row)
    return F.array_distinct(made)


def resolve(files: DataFrame, root: Column | None = None, aliases: DataFrame | None = None, imports: DataFrame | None = None) -> DataFrame:
    """``src, dst, ord``: for every import the first of its candidates that is a file; a target once per source, itself never.
    ``imports`` are those of ``raw_imports`` where they are known already; the files' contents aren't read then."""
    rows = (raw_imports(files) if imports is None else imports.select("src", "language", "ord", "import")).distinct()
    if root is not None:
        rows = rows.join(files.select(F.col("path").alias("src"), root.alias("root")).distinct(), "src")
    based = bases(rows, aliases)
    tried = F.flatten(F.transform("bases", lambda b: candidate_paths(b, F.col("language"))))
    each = based.select("src", "ord", F.posexplode(tried).alias("try", "dst"))
    met = each.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    first = met.groupBy("src", "ord").agg(F.min_by("dst", "try").alias("dst")).filter("src <> dst")
    once = first.groupBy("src", "dst").agg(F.min("ord").alias("first"))
    w = Window.partitionBy("src").orderBy("first")
    return once.select("src", "dst", (F.row_number().over(w) - 1).cast("int").alias("ord"))


def still_valid(cache: DataFrame, files: DataFrame, within: float = 0.01) -> DataFrame:
    """Cached imports (``src, mtime`` and more) of files whose time hasn't changed since."""
    now = files.select(F.col("path").alias("src"), F.col("mtime").alias("_now"))
    return cache.join(now, "src").filter(F.abs(F.col("mtime") - F.col("_now")) < within).drop("_now")


def reach(edges: DataFrame, start: DataFrame, depth: int, src: str = "src", dst: str = "dst", begin: int = 0) -> DataFrame:
    """``node, depth``: what ``start`` (column ``node``) reaches within ``depth`` hops, at its least depth.

    Each hop joins the frontier alone with the edges, which don't move where that is small, and leaves out what was met before; its lineage is
    cut, so hop n doesn't repeat the hops before it.
    """
    links = edges.filter(F.col(dst).isNotNull() & F.col(src).isNotNull()).select(F.col(src).alias("node"), F.col(dst).alias("next"))
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(begin)))
    frontier = seen
    for hop in range(begin + 1, begin + depth + 1):
        few = F.broadcast if frontier.limit(FEW + 1).count() <= FEW else lambda df: df
        new = links.join(few(frontier.select("node")), "node").select(F.col("next").alias("node")).distinct()
        frontier = cut(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """``path, depth, imports, imported_by``: what ``start`` reaches, and for each which others of these it imports and is imported by."""
    met = reach(edges, start, depth)
    near = met.select("node")
    pairs = importers(edges).join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").join(near.withColumnRenamed("node", "src"), "src", "left_semi")
    out = pairs.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    back = pairs.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("imported_by"))
    none = F.array().cast(STRINGS)
    return met.join(out, "node", "left").join(back, "node", "left").select(F.col("node").alias("path"), "depth", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def importers(edges: DataFrame) -> DataFrame:
    """``dst, src``: each pair once."""
    return edges.filter(F.col("dst").isNotNull()).select("dst", "src").distinct()


def impact(edges: DataFrame, targets: DataFrame, depth: int = 3, fuzzy: DataFrame | None = None) -> DataFrame:
    """``path, depth, kind``: direct importers (and ``fuzzy`` dependents), then what depends on them, without the targets."""
    direct = importers(edges).join(targets.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    if fuzzy is not None:
        direct = direct.unionByName(fuzzy.select("node"))
    direct = direct.join(targets, "node", "left_anti").distinct()
    met = reach(edges, direct, depth - 1, "dst", "src", 1)
    return met.join(targets, "node", "left_anti").select(F.col("node").alias("path"), "depth", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("kind"))
