"""Problem 4: source files that nobody wrote by hand in their repository.

Each file is read once, and the hashes of its lines go to an inverted index. In this
index the lines that the fewest contents hold lead from files outside of third-party folders to third-party files of other
repositories, and the containment of their lines is then computed exactly: an edited copy that has
lost its notice. Exact copies of a content are one entry of the index, so they multiply nothing. Where a file lies, what
it says of itself in the comments it opens or closes with, and the composition of its tokens decide the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .docpairs import FAMILIES, blanked
from .hot import anonymous, salted

#: A line is rare that at most so many distinct contents hold (this sets the cost, not the result); a file is a copy that has this share of its lines in another.
RARE, CONTAINED = 20, 0.8
#: Shares of a file's code from which it is minified (code on lines longer than LONG) or data (literals).
LONG, MINIFIED, DATA = 200, 0.5, 0.8
# Folders of third-party code, names that tools give, and the words of notices.
_FOLDERS = r"(?:^|/)(?:_?vendor(?:ed|s)?|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|pods|carthage|externs?|externals?|deps|site-packages|godeps)/"
_FOLDER = re.compile(_FOLDERS, re.I)
_GENERATED_NAME = re.compile(r"(?:\.pb\.(?:go|cc|h)|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts)|\.g(?:en(?:erated)?)?\.\w+|\.designer\.\w+|_generated\.\w+|zz_generated\.\w+|OuterClass\.java|Grpc\.java)$", re.I)
_MINIFIED_NAME = re.compile(r"(?:[.-](?:min|bundle|prod|packed|umd\.prod)\.(?:m|c)?js|\.chunk\.(?:m|c)?js)$", re.I)
_ABOUT_ITSELF = frozenset("a all an and are been code class contents copyright file following has have in is it its module of package program script source text the these this was were".split()) | frozenset(
    "ce cette cet code classe est été fichier le module programme source archivo clase código el este esta fichero ha sido fue es diese dieser das dies die datei der klasse quelltext quelle wurde wird ist worden".split()
)
_MADE = frozenset("generated autogenerated emitted erzeugt generiert généré générée generado generada".split())
#: People do these too: by itself or not to be edited must be said beside them.
_MADE_SO = _MADE | frozenset("produced created built written compiled rendered derived erstellt produit créé compilé producido creado".split())
_BY_ITSELF = frozenset("auto automatic automatically autogenerated machine automatisch automatiquement automáticamente".split())
_MAKER = frozenset("by from with using via par avec von mit aus durch por con desde".split())
_UNTOUCHED = re.compile(
    r"\b(?:do(?:es)? not|don['’]t|never) (?:edit|modify|change|touch|alter)\b|\b(?:changes|edits|modifications)\b.{0,48}\b(?:lost|overwritten|discarded)\b|\bregenerate\b|\binstead of editing\b|"
    r"\bne pas (?:modifier|éditer|changer)\b|\bnicht (?:bearbeiten|ändern|editieren|verändern)\b|\bno (?:editar|edite|modificar|modifique|tocar)\b",
    re.I,
)
_TAKEN = frozenset("bundled copied extracted forked imported kopiert mirrored taken vendored copié copiado importé importado übernommen".split())
_COPY = frozenset("copy fork mirror snapshot copie kopie copia".split())
_ORIGIN = re.compile(r"\bupstream\b|https?://|(?<![\w.])v?\d+\.\d+[\w.]*|@\d", re.I)
_ELSEWHERE = re.compile(r"\bsend (?:all )?(?:changes|patches|fixes) upstream\b|\b(?:not |un)maintained (?:in this|here)\b|\bmaintained (?:upstream|elsewhere)\b", re.I)
_NAME_FIRST = re.compile(r"[^\w@]*[\w./@+-]+\s+v?\d[\w.]*\W*$")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"(?<![\w.])(?:0[xX][0-9a-fA-F_]+|\d[\d_.]*(?:[eE][+-]?\d+)?)[a-zA-Z]{0,3}\b")
_PLAIN = re.compile(r"\S+")


def _notices(text: str, comments: list[tuple[int, int]], code: str) -> Iterator[str]:
    """Comment lines before the first and after the last line of code."""
    first = len(code) - len(code.lstrip(" \t\n\x01﻿"))
    last = len(code.rstrip(" \t\n\x01"))
    for s, e in comments:
        if e <= first or s >= last:
            yield from text[s:e].splitlines()


def _tools(line: str) -> bool:
    """Whether a comment line says of its file that a tool makes it: what made it or that it came by itself, with nothing
    but the file as what is made; or that it was made and isn't to be edited."""
    low = line.lower()
    if "@generated" in low:
        return True
    words = _PLAIN_WORD.findall(low)
    untouched = bool(_UNTOUCHED.search(low))
    if words[:1] == ["do"] and untouched or untouched and (not _MADE_SO.isdisjoint(words) or "output" in words[:2]):
        return True
    for k, w in enumerate(words):
        if w in _MADE_SO:
            # German has the maker before the verb
            before = [x for n, x in enumerate(words[:k]) if x not in _MAKER and (n == 0 or words[n - 1] not in _MAKER)]
            own = all(x in _ABOUT_ITSELF or x in _BY_ITSELF for x in before)
            alone = w == "autogenerated" or not _BY_ITSELF.isdisjoint(words[:k]) or not _BY_ITSELF.isdisjoint(words[k + 1 : k + 2])
            return own and (alone or w in _MADE and (not _MAKER.isdisjoint(words[k + 1 : k + 2]) or len(before) < k))
        if w not in _ABOUT_ITSELF and w not in _BY_ITSELF and w not in _MAKER and (k == 0 or words[k - 1] not in _MAKER):
            return False
    return False


def _others(line: str) -> bool:
    """Whether a comment line says of its file that it was taken over from elsewhere."""
    low = line.lower()
    if _ELSEWHERE.search(low):
        return True
    for m in _PLAIN_WORD.finditer(low):
        if m[0] in _TAKEN or m[0] in _COPY:
            head = low[: m.start()]
            own = all(w in _ABOUT_ITSELF for w in _PLAIN_WORD.findall(head)) or bool(_NAME_FIRST.match(head))
            return own and bool(_ORIGIN.search(low))
    return False


def verdict(path: str, text: str) -> tuple[str | None, str | None, str | None]:
    """Why nobody wrote this file here, what shows it, and by which step; nothing if nothing does."""
    family = FAMILIES.get(path.rpartition(".")[2].lower())
    if m := _FOLDER.search(path):
        return "vendored", m[0].strip("/"), "path"
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if family is None:
        code, comments, strings = text, [], []
    else:
        code, comments, strings = blanked(text, family)
    # a docstring that opens a Python file may carry the notice too
    opening = [(s, e) for s, e in strings[:1] if family == "python" and not code[:s].strip(" \t\n\x01﻿")]
    for line in _notices(text, sorted(comments + opening), code):
        if _others(line):
            return "vendored", line.strip(), "notice"
        if _tools(line):
            return "generated", line.strip(), "notice"
    if m := _GENERATED_NAME.search(path):
        return "generated", m[0], "path"
    if m := _MINIFIED_NAME.search(path):
        return "minified", m[0], "path"
    bare = code.replace("\x01", "")
    quoted = sum(e - s for s, e in strings)
    solid = sum(map(len, _PLAIN.findall(bare)))
    if solid + quoted == 0:
        return None, None, None
    literal = quoted + sum(len(m[0]) for m in _NUMBER.finditer(bare)) + sum(map(bare.count, ",[]{}()"))
    if literal / (solid + quoted) > DATA and (n := len(text)) >= 200:
        return "data", f"{100 * literal // (solid + quoted)} % literals of {n} characters", "composition"
    long = sum(len(line) for x in code.split("\n") if len(line := x.replace("\x01", "")) > LONG)
    if long / len(bare) > MINIFIED:
        return "minified", f"{100 * long // len(bare)} % of the code on long lines", "composition"
    return None, None, None


#: Lines of fewer characters, such as brackets, tell nothing about where a file comes from.
LEAST_LINE = 12
_LINE_END = re.compile(r"\r\n?|\n")


def line_hashes(text: str) -> np.ndarray:
    """The hashes of the distinct lines, without blanks around them, in order of hash."""
    lines = {s for x in _LINE_END.split(text) if len(s := x.strip(" \t")) >= LEAST_LINE}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(s) for s in lines), np.uint64, len(lines)).view(np.int64))


_CLAIM = re.compile(r"copyright|licen[cs]e|\(c\)|©|@author|@version|upstream|https?://", re.I)


def claims(repo: str | None, path: str, text: str) -> bool:
    """Whether the comments a file opens or closes with name an origin other than its repository."""
    family = FAMILIES.get(path.rpartition(".")[2].lower())
    if family is None or not _CLAIM.search(text):
        return False
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    code, comments, _ = blanked(text, family)
    lines = list(_notices(text, comments, code))
    return any(map(_CLAIM.search, lines)) and not (repo and any(repo in x for x in lines))


VERDICT = "file_id bigint, repo string, path string, content_id bigint, reason string, evidence string, step string, claims boolean, lines array<bigint>, other bigint"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        repos, paths, texts = (b.column(i).to_pylist() for i in (1, 2, 3))
        found = [verdict(p, t) for p, t in zip(paths, texts)]
        yield pa.RecordBatch.from_arrays(
            [
                *(b.column(i) for i in range(3)),
                pa.array([_signed(xxhash.xxh3_64_intdigest(t)) for t in texts], pa.int64()),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.string()),
                pa.array([f[2] for f in found], pa.string()),
                pa.array([f[0] is None and claims(r, p, t) for f, r, p, t in zip(found, repos, paths, texts)], pa.bool_()),
                pa.array([line_hashes(t) for t in texts], pa.list_(pa.int64())),
                b.column(4),
            ],
            ["file_id", "repo", "path", "content_id", "reason", "evidence", "step", "claims", "lines", "other"],
        )


def _rows(files: DataFrame) -> DataFrame:
    code = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*FAMILIES)
    return files.filter(code & F.col("content").rlike(r"\S")).select("file_id", "repo", "path", "content", anonymous("file_id", "repo", "path", "content").alias("other"))


def provenance(files: DataFrame) -> DataFrame:
    """``file_id, repo, path, reason, evidence, step, containment, source`` for every file in a programming language.

    ``reason`` is ``generated``, ``minified``, ``vendored``, ``data``, or null for hand-written
    source; ``step`` is what decided: ``path``, ``notice``, ``containment`` or ``composition``. An undecided file at least CONTAINED of whose lines stand in a third-party file of another
    repository gets that share and the other's content as ``containment`` and ``source``. It is
    ``vendored`` if its comments claim another origin than its repository, which alone would prove
    nothing; without any claim it stays undecided, since only where a file lies or what it says of itself
    makes it third-party. Rows delivered again give one, and files with a null ``file_id`` are told apart by repository,
    path and content; null or blank content, a null path and other extensions give none.
    """
    read = cut(_rows(files).mapInArrow(_read, VERDICT))
    # delivered again or not, a content is one entry of the index; only verdicts are made distinct
    found = contained(read.filter("reason is null"), read.filter("reason = 'vendored'"))
    joined = read.drop("lines").dropDuplicates(["file_id", "other"]).join(found, "content_id", "left")
    copied = F.col("reason").isNull() & F.col("claims") & F.col("containment").isNotNull()
    said = {"reason": F.lit("vendored"), "evidence": F.concat(F.lit("edited copy of content "), F.col("source").cast("string")), "step": F.lit("containment")}
    return joined.select("file_id", "repo", "path", *(F.when(copied, v).otherwise(F.col(k)).alias(k) for k, v in said.items()), "containment", "source")


def containment(files: DataFrame, share: float = CONTAINED) -> DataFrame:
    """``file_id, repo, path, containment``: files outside of third-party folders at least ``share`` of whose lines stand in one
    file of such a folder in another repository, with the largest share. Rows as for ``provenance``."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            ids = pa.array([_signed(xxhash.xxh3_64_intdigest(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), ids, pa.array([line_hashes(t) for t in texts], pa.list_(pa.int64())), b.column(4)], ["file_id", "repo", "path", "content_id", "lines", "other"])

    read = cut(_rows(files).mapInArrow(lines, "file_id bigint, repo string, path string, content_id bigint, lines array<bigint>, other bigint"))
    inside = F.col("path").rlike("(?i)" + _FOLDERS)
    found = contained(read.filter(~inside), read.filter(inside), share)
    return read.filter(~inside).drop("lines").dropDuplicates(["file_id", "other"]).join(found, "content_id").select("file_id", "repo", "path", "containment")


def _hits(contents: DataFrame, first, df: DataFrame, share: float) -> DataFrame:
    """``line, content_id, n, lacks, df``: of the ``first`` lines of each content those that third-party contents hold."""
    lacks = F.floor(F.size("lines") * F.lit(1 - share) + 1e-9).cast("int")
    asked = contents.select(F.explode(F.slice("lines", F.lit(1), first(lacks))).alias("line"), "content_id", F.size("lines").alias("n"), lacks.alias("lacks")).distinct()
    asked, df = salted(asked, df, "line", ["content_id"])
    return asked.join(df, ["line", "salt"]).drop("salt")


def contained(asked_files: DataFrame, third: DataFrame, share: float = CONTAINED) -> DataFrame:
    """``content_id, containment, source`` of contents that copy a third-party one from another repository;
    both tables have ``content_id, repo, lines``.

    A content of n lines that has ``share`` of them in another lacks few: among any m of its lines it
    shares m less those. So the first lines by hash are looked up, twice as many as it may lack, and a content
    of which fewer than half are held by third parties is no copy. Of the others all lines are looked up and
    put in order, those first that the fewest third-party contents hold: a source that holds enough of them holds one
    of the first, however many hold it (prefix filter), so no pair is lost. Lines that at most RARE hold lead to
    their sources too, since each that a source must share makes the pairs fewer.
    """
    held = third.select(F.explode("lines").alias("line"), F.col("content_id").alias("source"), F.size("lines").alias("m")).distinct()
    df = held.groupBy("line").agg(F.count("*").alias("df"))
    tried = _hits(asked_files, lambda lacks: lacks + F.greatest(lacks, F.lit(1)), df, share).groupBy("content_id").agg(F.count("*").alias("met"), F.first("lacks").alias("lacks"), F.first("n").alias("n"))
    # of fewer lines than are looked up, as where a small share is enough, it may lack as many
    likely = cut(tried.filter(F.col("met") >= F.greatest(F.least("n", F.col("lacks") + F.greatest("lacks", F.lit(1))) - F.col("lacks"), F.lit(1))).select("content_id"))
    hits = _hits(asked_files.join(likely, "content_id", "left_semi"), lambda lacks: F.size("lines"), df, share)
    of_content = Window.partitionBy("content_id")
    ranked = hits.withColumns({"met": F.count("*").over(of_content), "nth": F.row_number().over(of_content.orderBy("df", "line"))}).withColumn("needed", F.col("n") - F.col("lacks"))
    leads = ranked.filter((F.col("met") >= F.col("needed")) & ((F.col("nth") <= F.col("met") - F.col("needed") + 1) | (F.col("df") <= RARE)))
    # what a source must share of the leading lines if it holds all the others
    leads = cut(leads.withColumn("least", F.col("needed") - F.col("met") + F.count("*").over(of_content)).select("line", "content_id", "n", "least", "df"))
    asked, offered = salted(leads, held, "line", ["content_id"], F.sum("df"))
    shared = asked.join(offered, ["line", "salt"]).filter(F.col("m") >= F.col("n") * share - 1e-9).groupBy("content_id", "source", "least").agg(F.count("*").alias("shared"))
    pairs = cut(shared.filter(F.col("shared") >= F.col("least")).select("content_id", "source"))
    repos = [F.min("repo"), F.max("repo")]
    # a content in one repository only can't have come from that same repository
    of = asked_files.join(pairs.select("content_id").distinct(), "content_id", "left_semi").groupBy("content_id").agg(F.first("lines").alias("own"), *(r.alias(n) for r, n in zip(repos, "az")))
    to = third.withColumnRenamed("content_id", "source").join(pairs.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.first("lines").alias("others"), *(r.alias(n) for r, n in zip(repos, "by")))
    part = F.size(F.array_intersect("own", "others")) / F.size("own")
    elsewhere = (F.col("a") != F.col("z")) | (F.col("b") != F.col("y")) | (F.col("a") != F.col("b"))
    held_by = pairs.join(of, "content_id").join(to, "source").filter(elsewhere).select("content_id", "source", part.alias("containment")).filter(F.col("containment") >= share)
    return held_by.groupBy("content_id").agg(F.max(F.struct("containment", "source")).alias("b")).select("content_id", "b.containment", "b.source")
