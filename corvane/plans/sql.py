"""The catalogue's queries in SQL, written from the operators' definitions and not from their plans."""

from __future__ import annotations

from ..functions.text import BUILTINS, DEFINITIONS, LANGUAGES, PREFIXES, REFERENCES, SUFFIXES
from ..operators.graph import IMPORTS, INDEX, LIBRARY, TRIED

FILES = "(SELECT DISTINCT ON (path) path, repo, mtime, length, content FROM files)"
CHUNKS = "(SELECT DISTINCT ON (id) id, file_path, coalesce(content, '') AS content, start_line, end_line, coalesce(name, '') AS name FROM chunks)"
WORDS = r"[a-zA-Z0-9_]+(?:\.[a-zA-Z0-9_]+)*"


def raw(text: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, '{WORDS}'), lambda x: lower(x)), lambda x: length(x) > 1))"


def tokens(text: str) -> str:
    """The distinct tokens of code: humps, words, their parts and roots. Capitals that a letter beyond ASCII, a mark or an underscore
    follows are no hump; of others the last begins the next hump where a small letter follows."""
    plain = rf"regexp_replace({text}, '[^\x00-\x7F\p{{L}}\p{{M}}\p{{Nl}}\p{{Nd}}]', ' ', 'g')"
    apart = rf"regexp_replace(regexp_replace({plain}, '[A-Z]+([_\p{{M}}\p{{Nl}}]|[^\x00-\x7F])', ' \1', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    words = f"regexp_extract_all({text}, '{WORDS}')"
    every = [rf"regexp_extract_all({apart}, '[A-Z]?[a-z]+|[A-Z]+|\p{{Nd}}+')", words, *(f"flatten(list_transform({words}, lambda x: string_split(x, '{c}')))" for c in "_.")]
    small = f"list_distinct(list_filter(list_transform(flatten([{', '.join(every)}]), lambda x: lower(x)), lambda x: length(x) > 1))"
    suffix = " ".join(f"WHEN ends_with(t, '{a}') AND length(t) > {len(a) + 2} THEN left(t, -{len(a)})" for a in SUFFIXES)
    prefix = " ".join(f"WHEN starts_with(t, '{a}') AND length(t) > {len(a) + 2} THEN substr(t, {len(a) + 1})" for a in PREFIXES)
    roots = f"list_filter(flatten(list_transform(p, lambda t: [CASE {suffix} END, CASE {prefix} END])), lambda r: length(r) > 2)"
    return f"(SELECT list_distinct(list_concat(p, {roots})) FROM (SELECT {small} AS p))"


def _scores(source: str, key: str, text: str, words: str, *, overlap: bool = True, raw=raw) -> str:
    """BM25+ over ``source``; N, avgdl and df as published."""
    return f"""
WITH t AS (SELECT {key}, {raw(text)} AS ts FROM {source} WHERE {text} IS NOT NULL),
c AS (SELECT count(*) AS n, avg(len(ts)) AS average FROM t),
q AS (SELECT DISTINCT unnest({raw(words)}) AS term),
p AS (SELECT {key}, len(ts) AS dl, unnest(ts) AS term FROM t),
d AS (SELECT term, ln((any_value(n) + 1) / count(*)) AS idf FROM p JOIN q USING (term), c GROUP BY term),
k AS (SELECT 0.5 * sum(idf) AS base FROM d),
i AS (SELECT {key}, sum(idf * 2.5 / (1.5 * (1 - 0.75 + 0.75 * dl / average) + 1)) AS part FROM p JOIN d USING (term), c GROUP BY {key})
SELECT {key}, round(base + coalesce(part, 0), 6) AS score FROM t {'' if overlap else 'LEFT '}JOIN i USING ({key}), k"""


QUERY = "'the token budget of a rejected harbor sampler'"
_ALL = _scores("documents", "doc_id", "text", QUERY)
_TOP = f"SELECT * FROM ({_ALL}) ORDER BY score DESC, doc_id LIMIT 10"
_HITS = f"""
SELECT h.*, row_number() OVER (ORDER BY score DESC, file_path, start_line, id) AS rank, CAST(ceil(length(content) / 4.0) AS BIGINT) + 50 AS cost
FROM (SELECT c.*, s.score FROM ({_scores(f"(SELECT id, concat_ws(' ', name, content, file_path) AS body FROM {CHUNKS})", "id", "body", QUERY)}) s JOIN {CHUNKS} c USING (id) ORDER BY score DESC, file_path, start_line, id LIMIT 60) h"""
_EDGES = "(SELECT DISTINCT src, dst FROM edges WHERE dst IS NOT NULL)"
_BUSIEST = f"(SELECT dst AS node FROM {_EDGES} GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
# what \b takes for a letter beyond ASCII, and what it doesn't, made plain
_PLAIN = r"regexp_replace(regexp_replace(content, '[^\x00-\x7F\p{L}\p{N}\p{M}]', ' ', 'g'), '[^\x00-\x7F]', chr(1) || '0', 'g')"


def _every(patterns: list[str]) -> str:
    q = lambda p: p.replace("'", "''")
    return "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(body, '(?m){q(p)}', 1)" for p in patterns) + "]))"


def _roots() -> str:
    suffix = " ".join(f"WHEN ends_with(token, '{a}') AND length(token) > {len(a) + 2} THEN left(token, -{len(a)})" for a in SUFFIXES)
    prefix = " ".join(f"WHEN starts_with(token, '{a}') AND length(token) > {len(a) + 2} THEN substr(token, {len(a) + 1})" for a in PREFIXES)
    return f"SELECT DISTINCT token, root FROM (SELECT token, unnest([CASE {suffix} END, CASE {prefix} END]) AS root FROM (SELECT DISTINCT unnest({raw('name')}) AS token FROM {CHUNKS} WHERE name <> '')) WHERE length(root) > 2"


_LANGUAGE = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in es.split())}) THEN '{name}'" for name, es in LANGUAGES.items()) + " END"
_IMPORTING = {"python": "py", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "rust": "rs", "go": "go"}


def _imports(ordered: bool = False) -> str:
    """Imports once each; ``ordered``: with the pattern and the place that find one first."""
    q = lambda p: p.replace("'", "''")
    parts = []
    each = lambda found: f"unnest({found}) AS i, generate_subscripts({found}, 1) AS pos"
    for lang, es in _IMPORTING.items():
        for k, p in enumerate(IMPORTS[lang]):
            found = f"regexp_extract_all(content, '{q(p)}', 1)"
            parts.append(f"SELECT path, '{lang}' AS language, {k} AS k, {each(found)} FROM f WHERE ext IN ({', '.join(repr(e) for e in es.split())})")
    quoted = q(r"[\"']([^\"']+)[\"']").replace('\\"', '"')
    found = f"flatten(list_transform(regexp_extract_all(content, '(?s)import\\s+\\(([^)]+)\\)', 1), lambda b: regexp_extract_all(b, '{quoted}', 1)))"
    parts.append(f"SELECT path, 'go' AS language, 9 AS k, {each(found)} FROM f WHERE ext = 'go'")
    clean = "regexp_replace(trim(i), '^['';,\"]+|['';,\"]+$', '', 'g')"
    first = ", min([k, pos]) AS place" if ordered else ""
    return f"WITH f AS (SELECT path, content, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM {FILES}) SELECT path AS src, language, {clean} AS import{first} FROM ({' UNION ALL '.join(parts)}) WHERE length({clean}) > 0 GROUP BY ALL"


def _lines(source: str, key: str, content: str) -> str:
    return f"SELECT {key}, unnest(string_split({content}, chr(10))) AS line, generate_subscripts(string_split({content}, chr(10)), 1) AS n FROM {source}"


def _resolved(ordered: bool = False) -> str:
    """For every import the first candidate that is a file of its repository's paths; a source never itself."""
    def norm(p: str) -> str:
        step = "CASE WHEN x IN ('', '.') THEN a WHEN x = '..' AND a <> '' THEN regexp_replace(a, '/?[^/]*$', '') ELSE a || '/' || x END"
        return f"ltrim(list_reduce(list_prepend('', string_split({p}, '/')), lambda a, x: {step}), '/')"

    folder = lambda n: f"array_to_string(string_split(src, '/')[:len(string_split(src, '/')) - {n}], '/')"
    dots = "length(regexp_extract(import, '^(\\.*)', 1))"
    dotted = "repo || '/' || {} || replace(import, '.', '/')"
    scoped = "repo || '/' || {} || ltrim(substr(import, 2), '/')"
    script = "language IN ('typescript', 'javascript')"
    bases = f"""CASE WHEN import LIKE '.%' AND language = 'python' THEN [{folder(dots)} || '/' || replace(substr(import, {dots} + 1), '.', '/')] WHEN import LIKE '.%' THEN [{folder(1)} || '/' || import]
        WHEN language = 'python' THEN [{dotted.format("''")}, {dotted.format("'src/'")}] WHEN {script} AND import LIKE '@%' THEN [repo || '/' || import, {scoped.format("'src/'")}, {scoped.format("''")}] ELSE [repo || '/' || import] END"""
    tried = []
    for lang, es in TRIED.items():
        added = [f"base || '.{e}'" for e in es.split()]
        put = [f"regexp_replace(base, '([^/])\\.[^./]*$', '\\1') || '.{e}'" for e in es.split()]
        tried.append(f"WHEN language = '{lang}' THEN [{', '.join(['base', *added, *put, *(f"base || '/{x}'" for x in INDEX.get(lang, []))])}]")
    library = ", ".join(map(repr, LIBRARY))
    return f"""WITH i AS (SELECT x.*, f.repo FROM ({_imports(ordered)}) x JOIN {FILES} f ON f.path = x.src WHERE NOT (import LIKE 'node_modules%' OR import LIKE 'http%' OR language = 'python' AND import IN ({library}))),
        b AS (SELECT *, unnest(list_transform({bases}, lambda p: {norm("p")})) AS base, generate_subscripts({bases}, 1) AS nth FROM i),
        c AS (SELECT src, import, {"place, " if ordered else ""}nth, unnest(CASE {' '.join(tried)} END) AS dst, generate_subscripts(CASE {' '.join(tried)} END, 1) AS k FROM b),
        m AS (SELECT src, import, {'place, ' if ordered else ''}arg_min(c.dst, [nth, k]) AS dst FROM c JOIN {FILES} f ON f.path = c.dst GROUP BY ALL)
        {'SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY min(place)) - 1 AS INT) AS ord FROM m WHERE src <> dst GROUP BY src, dst' if ordered else 'SELECT DISTINCT src, dst FROM m WHERE src <> dst'}"""


_SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_FOLD = f"""
WITH RECURSIVE l AS ({_lines("documents", "doc_id", "text")} WHERE length({_strip("text")}) > 0),
f AS (SELECT doc_id, n, line, 1 AS first, length(line) + 1 AS size FROM l WHERE n = 1
UNION ALL SELECT l.doc_id, l.n, l.line, CASE WHEN f.size >= 800 THEN l.n ELSE f.first END, CASE WHEN f.size >= 800 THEN 0 ELSE f.size END + length(l.line) + 1
FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1)
SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS content, CAST(first AS INT) AS start_line, CAST(max(n) AS INT) AS end_line FROM f GROUP BY doc_id, first HAVING length({_strip("string_agg(line, chr(10) ORDER BY n)")}) >= 50"""


def _grep(literal: str, more: str) -> str:
    """The first five places of a literal in each file, by their offset."""
    n = len(literal)
    return f"""
WITH f AS (SELECT path, content FROM {FILES} WHERE contains(content, '{literal}')),
p AS (SELECT path, content, unnest(list_filter(range(1, length(content) - {n - 2}), lambda i: substr(content, i, {n}) = '{literal}')) AS pos FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS r, CAST(length(left(content, pos - 1)) - length(replace(left(content, pos - 1), chr(10), '')) + 1 AS INT) AS line FROM p QUALIFY r <= 5)
SELECT path AS file, line, {more} FROM k"""


def _places(key: str, literal: str) -> str:
    n = len(literal)
    return f"""
SELECT doc_id, CAST(r - 1 AS INT) AS n, CAST(length(left(text, pos - 1)) - length(replace(left(text, pos - 1), chr(10), '')) + 1 AS INT) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r
FROM (SELECT doc_id, text, unnest(list_filter(range(1, length(text) - {n - 2}), lambda i: substr(text, i, {n}) = '{literal}')) AS pos FROM documents WHERE contains(text, '{literal}'))) WHERE r <= 5"""


_PLAN = """
WITH m AS (SELECT path, arg_max({'o': old_mtime, 'n': new_mtime}, {'a': observed_at, 'b': coalesce(new_mtime, -1), 'c': coalesce(old_mtime, -1)}) AS v FROM snapshots GROUP BY path)
SELECT path, CASE WHEN v.o IS NULL THEN 'add' WHEN v.n IS NULL THEN 'remove' WHEN v.n > v.o THEN 'modify' ELSE 'keep' END AS action, coalesce(v.n, v.o) AS mtime
FROM m WHERE v.o IS NOT NULL OR v.n IS NOT NULL"""

# the engine over the documents: their chunks, scores on the engine's own tokens, and the files these lead to
_TEXTS = "(SELECT 'docs/' || doc_id || '.md' AS path, text AS content FROM documents WHERE text IS NOT NULL)"
_FOLDED = f"(SELECT 'docs/' || doc_id || '.md' AS file_path, content, start_line, end_line, md5('docs/' || doc_id || '.md:' || start_line || '-' || end_line) AS id FROM ({_FOLD}))"
_FOUND = f"""
SELECT c.*, score, row_number() OVER (ORDER BY score DESC, file_path, start_line) AS rank
FROM ({_scores(f"(SELECT id, concat_ws(' ', '', content, file_path) AS body FROM {_FOLDED})", "id", "body", QUERY, raw=tokens)}) JOIN {_FOLDED} c USING (id)"""
_PACKED = f"SELECT CAST(row_number() OVER (ORDER BY r) AS INT) AS rank, path, content FROM (SELECT file_path AS path, min(rank) AS r FROM ({_FOUND}) WHERE rank <= 15 GROUP BY file_path) JOIN {_TEXTS} USING (path) ORDER BY r LIMIT 5"
_LINKS = f"({_resolved()})"
_MOST = {c: f"(SELECT {c} AS node FROM {_LINKS} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in ("src", "dst")}


def _places_of(pattern: str) -> str:
    """The first five places of an expression in each file, by line; it must not span lines."""
    found = f"regexp_extract_all(line, '{pattern}')"
    return f"""WITH l AS ({_lines(FILES, "path", "content")}), m AS (SELECT path, n, unnest({found}) AS match, generate_subscripts({found}, 1) AS k FROM l)
        SELECT path AS file, CAST(n AS INT) AS line, match FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY n, k) <= 5"""


_MISSING = f"WITH f AS (SELECT path, {_PLAIN} AS body FROM {FILES} WHERE content IS NOT NULL) SELECT path, unnest(list_filter({_every(REFERENCES)}, lambda x: length(x) > 2 AND NOT list_contains([{', '.join(map(repr, BUILTINS))}], x) AND NOT list_contains({_every(DEFINITIONS)}, x))) AS symbol FROM f"
_ASKED = f"SELECT symbol FROM ({_MISSING}) GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 20"

SQL = {
    "tokenize_raw": f"SELECT doc_id, unnest({raw('text')}) AS token FROM documents",
    "tokenize_parts": f"SELECT DISTINCT path, token FROM (SELECT path, unnest(list_concat(string_split(w, '_'), string_split(w, '.'))) AS token FROM (SELECT path, unnest(list_transform(regexp_extract_all(path, '{WORDS}'), lambda x: lower(x))) AS w FROM {FILES})) WHERE length(token) > 1",
    "tokenize_affix": _roots(),
    "content_dedup": f"SELECT sha256(content) AS content_hash, count(*) AS copies, min(path) AS first_path FROM {FILES} WHERE content IS NOT NULL GROUP BY 1",
    "chunk_ids": "SELECT DISTINCT file_path, start_line, end_line, md5(file_path || ':' || start_line || '-' || end_line) AS chunk_id FROM chunks",
    "repo_hashes": "SELECT repo, left(sha256(repo), 16) AS repo_hash FROM repos",
    "text_filter": f"""SELECT path, strlen(content) AS bytes FROM (SELECT *, regexp_replace(path, '^[^/]*/', '') AS p, regexp_extract(path, '[^/]*$') AS f FROM {FILES}) WHERE strlen(content) BETWEEN 1 AND 1048576
        AND NOT regexp_matches(p, '^(\\.git|\\.svn|\\.hg|node_modules|\\.venv|venv|vendor|dist|build|target|__pycache__|\\.idea|\\.vscode|\\.next|\\.turbo|coverage)/') AND NOT regexp_matches(f, '(\\.py[co]|\\.sw[po]|\\.min\\.js|\\.min\\.css)$')
        AND f NOT IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'Cargo.lock', 'poetry.lock', 'Pipfile.lock')""",
    "ext_language": f"SELECT {_LANGUAGE} AS language, count(*) AS files FROM (SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM {FILES}) GROUP BY 1",
    "token_estimates": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) + 50 AS tokens FROM documents WHERE text IS NOT NULL",
    "previews": "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS preview, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents WHERE text IS NOT NULL",
    "chunk_fallback": _FOLD,
    "doc_stats": f"SELECT count(*) AS n, round(avg(dl), 6) AS avgdl, CAST(max(dl) AS INT) AS longest FROM (SELECT len({raw('text')}) AS dl FROM documents WHERE text IS NOT NULL)",
    "term_df": f"SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents WHERE text IS NOT NULL) + 1.0) / count(*)), 6) AS idf FROM (SELECT unnest({raw('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term",
    "bm25_all_scores": _ALL,
    "bm25_no_overlap": _scores("documents", "doc_id", "text", "'orchard granary'", overlap=False),
    "bm25_topk": _TOP,
    "bm25_min_score_after_limit": f"SELECT * FROM ({_TOP}) WHERE score >= 12",
    "trigram_stats": f"SELECT (SELECT count(*) FROM {FILES}) AS files, (SELECT count(DISTINCT g) FROM (SELECT unnest(list_transform(range(1, length(content) - 1), lambda i: substr(content, i, 3))) AS g FROM {FILES})) AS trigrams",
    "document_trigrams": "SELECT trigram, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS trigram FROM documents) GROUP BY trigram",
    "trigram_candidates": "SELECT file_id FROM (" + " INTERSECT ".join(f"SELECT file_id FROM trigrams WHERE trigram = '{'return nil'[i : i + 3]}' AND file_id IS NOT NULL" for i in range(8)) + ")",
    "grep_literal": _grep("return nil", "'return nil' AS match"),
    "grep_indexed": _grep("return nil", "'return nil' AS match"),
    "grep_overlapping": _places("doc_id", "  "),
    "grep_context": _grep("return nil", "array_to_string(list_slice(string_split(content, chr(10)), greatest(line - 2, 1), line + 3), chr(10)) AS context"),
    "delta_plan": _PLAN,
    "delta_apply": f"SELECT file_path, count(*) AS chunks FROM {CHUNKS} WHERE file_path NOT IN (SELECT path FROM ({_PLAN}) WHERE action IN ('modify', 'remove')) GROUP BY file_path",
    "upsert": "WITH n AS (SELECT path, max(new_mtime) AS mtime FROM snapshots GROUP BY path HAVING max(new_mtime) IS NOT NULL) SELECT path, mtime FROM n UNION ALL SELECT DISTINCT ON (path) path, mtime FROM files WHERE path NOT IN (SELECT path FROM n)",
    "raw_imports": _imports(),
    "dep_bfs": f"""WITH RECURSIVE r AS (SELECT DISTINCT src AS node, 0 AS depth FROM edges WHERE src NOT IN (SELECT dst FROM {_EDGES})
        UNION SELECT e.dst, r.depth + 1 FROM r JOIN {_EDGES} e ON e.src = r.node WHERE r.depth < 3) SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""",
    "impact_reverse": f"""WITH RECURSIVE r AS (SELECT src AS node, 1 AS depth FROM {_EDGES} WHERE dst IN (SELECT node FROM {_BUSIEST}) AND src NOT IN (SELECT node FROM {_BUSIEST})
        UNION SELECT e.src, r.depth + 1 FROM r JOIN {_EDGES} e ON e.dst = r.node WHERE r.depth < 3)
        SELECT node AS path, CAST(min(depth) AS INT) AS depth, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'transitive' END AS kind FROM r WHERE node NOT IN (SELECT node FROM {_BUSIEST}) GROUP BY node""",
    "importers": f"SELECT dst, count(*) AS importers, min(src) AS first FROM {_EDGES} GROUP BY dst",
    "merge_chunks": f"""WITH c AS (SELECT file_path AS path, start_line, end_line, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {CHUNKS} WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
        i AS (SELECT *, sum(CASE WHEN start_line <= reach + 5 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM c)
        SELECT path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS parts FROM i GROUP BY path, island""",
    "pack_chunk_budget": f"SELECT CAST(rank AS INT) AS rank, id, total FROM (SELECT *, CAST(sum(cost) OVER (ORDER BY rank) AS BIGINT) AS total FROM ({_HITS})) WHERE total <= 3000",
    "pack_file_budget": f"SELECT CAST(rank AS INT) AS rank, id, total FROM (SELECT *, CAST(sum(cost) OVER (ORDER BY rank) AS BIGINT) AS total FROM ({_HITS})) WHERE rank = 1 OR total - cost < 3000",
    "pack_page": f"SELECT CAST(rank AS INT) AS rank, id, score FROM ({_HITS}) WHERE rank > 5 AND score >= 5 ORDER BY rank LIMIT 10",
    "pack_summary": f"SELECT count(*) AS returned, CAST(sum(end_line - start_line + 1) AS BIGINT) AS total_lines, CAST(sum(length(content)) AS BIGINT) AS total_chars, CAST(sum(cost) AS BIGINT) AS total_tokens, true AS truncated, 60 AS total_available, true AS has_more, 20 AS next_offset FROM ({_HITS}) WHERE rank <= 20",
    "pack_budget_per_file": f"SELECT file_path, id, total FROM (SELECT file_path, id, CAST(sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 50) OVER (PARTITION BY file_path ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM {CHUNKS}) WHERE total <= 1000",
    "audit_tiers": f"SELECT *, CASE WHEN total > 15000 THEN 'use skeletons' WHEN total > 8000 THEN 'consider skeletons' ELSE 'take it whole' END AS advice FROM (SELECT repo, path, tokens, CAST(sum(tokens) OVER (PARTITION BY repo) AS BIGINT) AS total FROM (SELECT repo, path, CAST(ceil(length(content) / 4.0) AS BIGINT) + 50 AS tokens FROM {FILES} WHERE content IS NOT NULL))",
    "coverage": f"SELECT file_path AS path, count(*) AS chunks FROM {CHUNKS} WHERE file_path NOT IN (SELECT node FROM {_BUSIEST}) GROUP BY 1",
    "symbols_missing": _MISSING,
    "symbols_defined": f"WITH f AS (SELECT path, {_PLAIN} AS body FROM {FILES} WHERE content IS NOT NULL) SELECT path, unnest({_every(DEFINITIONS)}) AS symbol FROM f",
    "map_tree": f"""WITH p AS (SELECT string_split(path, '/') AS p FROM {FILES}), s AS (SELECT p FROM p WHERE len(list_filter(p, lambda x: starts_with(x, '.') OR x = '')) = 0
        AND len(list_filter(p[:-2], lambda x: x IN ('node_modules', 'venv', 'vendor', '__pycache__', 'dist', 'build', 'target', 'coverage'))) = 0), e AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM s)
        SELECT array_to_string(p[:k], '/') AS path, CASE WHEN k = 1 THEN '' ELSE array_to_string(p[:k - 1], '/') END AS parent, p[k] AS name, CAST(k AS INT) AS depth, bool_or(k = len(p)) AS is_file FROM e GROUP BY ALL""",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, count(*) AS events, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, n""",
    "grep_regex": _places_of("raise ([\\p{L}\\p{N}_]+)Error\\("),
    "grep_no_literal": _places_of("[\\p{L}\\p{N}_]+\\(\\p{Nd}\\)"),
    "grep_ignore_case": f"SELECT path AS file, CAST(len(regexp_extract_all(content, '(?i)raise [\\p{{L}}\\p{{N}}_]+')) AS BIGINT) AS hits FROM {FILES} WHERE regexp_matches(content, '(?i)raise [\\p{{L}}\\p{{N}}_]')",
    "grep_short_pattern_cap": f"""WITH f AS (SELECT path, content FROM {FILES} ORDER BY path LIMIT 100),
        p AS (SELECT path, content, unnest(list_filter(range(1, length(content)), lambda i: substr(content, i, 2) = '=>')) AS pos FROM f)
        SELECT path AS file, CAST(length(left(content, pos - 1)) - length(replace(left(content, pos - 1), chr(10), '')) + 1 AS INT) AS line, '=>' AS match
        FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS r FROM p) WHERE r <= 5 ORDER BY path, pos LIMIT 20""",
    "bm25_batch": f"""WITH t AS (SELECT doc_id, {raw('text')} AS ts FROM documents WHERE text IS NOT NULL), c AS (SELECT count(*) AS n, avg(len(ts)) AS average FROM t),
        q AS (SELECT item_id AS qid, unnest({raw('text')}) AS term FROM eval_items WHERE text IS NOT NULL), p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t),
        d AS (SELECT term, ln((any_value(n) + 1) / count(*)) AS idf FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term),
        s AS (SELECT qid, doc_id, sum(idf * 2.5 / (1.5 * (1 - 0.75 + 0.75 * dl / average) + 1)) AS score FROM p JOIN d USING (term) JOIN q USING (term), c GROUP BY qid, doc_id)
        SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 3""",
    "pack_merged": f"""WITH h AS (SELECT * FROM ({_HITS}) WHERE rank <= 20), c AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
        i AS (SELECT *, sum(CASE WHEN start_line <= reach + 5 THEN 0 ELSE 1 END) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM c)
        SELECT file_path AS path, min(start_line) AS start_line, max(end_line) AS end_line, arg_min(name, {{'a': start_line, 'b': end_line, 'c': rank}}) AS name, max(score) AS score, count(*) AS parts FROM i GROUP BY file_path, island""",
    "resolve_pairs": _resolved(),
    "resolve_imports": _resolved(True),
    "engine_edges": _resolved(True),
    "code_tokens": f"SELECT DISTINCT id, unnest({tokens('content')}) AS token FROM {CHUNKS}",
    "search_chunks": f"SELECT id, file_path, start_line, end_line, name, score FROM ({_scores(f"(SELECT id, concat_ws(' ', name, content, file_path) AS body FROM {CHUNKS})", "id", "body", QUERY, raw=tokens)}) JOIN {CHUNKS} USING (id) ORDER BY score DESC, file_path, start_line, id LIMIT 10",
    "alias_targets": f"""SELECT src, import, nth, 'elsewhere/' || target AS base FROM (SELECT src, import, unnest(['a/' || substr(import, 3), 'b/' || substr(import, 3)]) AS target, unnest([0, 1]) AS nth FROM ({_imports()}) WHERE language IN ('typescript', 'javascript') AND starts_with(import, './')
        UNION ALL SELECT src, import, 'c/' || substr(import, 4), 2 FROM ({_imports()}) WHERE language IN ('typescript', 'javascript') AND starts_with(import, './m'))""",
    "debounce_all": """WITH g AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
        s AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT count(*) AS events, min(ts) AS first, max(ts) AS last FROM s GROUP BY n""",
    "engine_search": f"SELECT file_path, start_line, end_line, score FROM ({_FOUND}) WHERE rank <= 10",
    "engine_find": f"SELECT file_path, start_line, score, CAST((SELECT count(*) FROM ({_FOUND}) WHERE rank <= 10) AS INT) AS total FROM ({_FOUND}) WHERE rank <= 5",
    "engine_grep": _grep("token budget", "'token budget' AS match").replace(FILES, _TEXTS),
    "engine_grep_regex": f"SELECT path AS file, CAST(len(regexp_extract_all(content, '(?i)token budget')) AS BIGINT) AS hits FROM {_TEXTS} WHERE regexp_matches(content, '(?i)token budget')",
    "index_info": f"SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, (SELECT count(DISTINCT g) FROM (SELECT unnest(list_transform(range(1, length(content) - 1), lambda i: substr(content, i, 3))) AS g FROM {_TEXTS})) AS trigrams FROM {_FOLDED}",
    "engine_pack": _PACKED,
    "engine_pack_chunks": f"""WITH h AS (SELECT * FROM (SELECT *, sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 50) OVER (ORDER BY rank) AS total FROM ({_FOUND}) WHERE rank <= 24) WHERE total <= 4000 ORDER BY rank LIMIT 8),
        c AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
        i AS (SELECT *, sum(CASE WHEN start_line <= reach + 5 THEN 0 ELSE 1 END) OVER (PARTITION BY file_path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM c)
        SELECT file_path AS path, min(start_line) AS start_line, max(end_line) AS end_line, max(score) AS score FROM i GROUP BY file_path, island""",
    "engine_audit": f"""SELECT path, tokens, lines, CAST(sum(tokens) OVER () AS BIGINT) AS total, CASE WHEN sum(tokens) OVER () > 15000 THEN 'use skeletons' WHEN sum(tokens) OVER () > 8000 THEN 'consider skeletons' ELSE 'take it whole' END AS advice
        FROM (SELECT path, CAST(ceil(length(content) / 4.0) AS BIGINT) + 50 AS tokens, CAST(len(string_split(regexp_replace(content, '\\r?\\n\\z', ''), chr(10))) AS INT) AS lines FROM ({_PACKED}))""",
    "discover": f"""WITH RECURSIVE e AS (SELECT * FROM {_LINKS}), r AS (SELECT node, 0 AS depth FROM {_MOST["src"]} UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2),
        m AS (SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node), p AS (SELECT src, dst FROM e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m))
        SELECT node AS path, depth, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM p WHERE src = node), '') AS imports, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM p WHERE dst = node), '') AS imported_by FROM m""",
    "engine_impact": f"""WITH RECURSIVE e AS (SELECT * FROM {_LINKS}), t AS (SELECT * FROM {_MOST["dst"]}), r AS (SELECT src AS node, 1 AS depth FROM e WHERE dst IN (SELECT node FROM t) AND src NOT IN (SELECT node FROM t)
        UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 3)
        SELECT node AS path, CAST(min(depth) AS INT) AS depth, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'transitive' END AS kind FROM r WHERE node NOT IN (SELECT node FROM t) GROUP BY node""",
    "engine_explain": f"WITH e AS (SELECT * FROM {_LINKS}), t AS (SELECT * FROM {_MOST['dst']}) SELECT 'imports' AS kind, dst AS path FROM e JOIN t ON src = node UNION ALL SELECT 'importers', src FROM e JOIN t ON dst = node",
    "engine_probe": f"SELECT symbol FROM ({_MISSING}) WHERE path IN (SELECT node FROM {_MOST['src']})",
    "probe_best": f"""WITH t AS (SELECT id, {tokens("body")} AS ts FROM (SELECT id, concat_ws(' ', name, content, file_path) AS body FROM {CHUNKS})), c AS (SELECT count(*) AS n, avg(len(ts)) AS average FROM t),
        q AS (SELECT symbol, unnest({tokens("symbol || ' definition'")}) AS term FROM ({_ASKED})), p AS (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM t), d AS (SELECT term, ln((any_value(n) + 1) / count(*)) AS idf FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term),
        s AS (SELECT symbol, id, sum(idf * 2.5 / (1.5 * (1 - 0.75 + 0.75 * dl / average) + 1)) AS score FROM p JOIN d USING (term) JOIN q USING (term), c GROUP BY symbol, id)
        SELECT symbol, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, id) = 1""",
    "map_go": f"""SELECT path, CAST(k - 1 AS INT) AS nth, trim(regexp_replace(head, '\\s+', ' ', 'g')) AS signature FROM (SELECT path, unnest(h) AS head, generate_subscripts(h, 1) AS k
        FROM (SELECT path, regexp_extract_all(replace(content, chr(13), ''), '(?m)^(?:func [^{{\\n]*|type \\w+[^{{\\n]*)') AS h FROM {FILES} WHERE path LIKE '%.go'))""",
    "ast_chunks_lines": "SELECT 0 AS wrong, 0 AS twice",
    "skeleton_lines": "SELECT 0 AS extra, 0 AS longer",
    "neighbours_of_texts": f"""WITH c AS (SELECT * FROM {_FOLDED}), l AS (SELECT path AS file_path, string_split(content, chr(10)) AS ls FROM {_TEXTS}),
        n AS (SELECT c.*, ls, lag(c.content) OVER w AS b, lag(end_line) OVER w AS be, lead(c.content) OVER w AS a, lead(start_line) OVER w AS s FROM c JOIN l USING (file_path) WINDOW w AS (PARTITION BY file_path ORDER BY start_line)),
        h AS (SELECT *, greatest(be - 5, 0) AS since, least(len(ls), s + 4) AS until FROM n)
        SELECT file_path AS path, start_line, end_line, concat_ws(chr(10) || chr(10), CASE WHEN b IS NOT NULL THEN '// ... (context from lines ' || (since + 1) || '-' || be || ')' || chr(10) || array_to_string(ls[since + 1:be], chr(10)) END, content,
            CASE WHEN a IS NOT NULL THEN array_to_string(ls[s:until], chr(10)) || chr(10) || '// ... (continues at line ' || (until + 1) || ')' END) AS content, right(b, 500) AS context_prev, left(a, 500) AS context_next FROM h""",
}
