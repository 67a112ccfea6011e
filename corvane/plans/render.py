"""Results as text. What comes here is bounded by the limits of the query."""

from __future__ import annotations

from typing import Any


def escape(text: Any, quotes: bool = False) -> str:
    text = str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;").replace("'", "&#x27;") if quotes else text


def attributes(**values: Any) -> str:
    return " ".join(f'{k}="{escape(v, True)}"' for k, v in values.items() if v is not None)


def pack(result: dict, form: str = "xml", *, quiet: bool = False, verbose: bool = False) -> str:
    if quiet:
        return _quiet(result)
    if form not in ("xml", "compact", "chunks"):
        raise ValueError(f"unknown format {form!r}")
    return {"xml": _xml, "compact": _compact, "chunks": _chunks}[form](result, verbose)


def _quiet(r: dict) -> str:
    """A line per result: its place, and its score and name where it has them, by tabs; then the totals."""
    rows = [(f["path"], f.get("score"), "") for f in r["files"]] + [(f"{c['path']}:{c['start_line']}-{c['end_line']}", c["score"], c["name"]) for c in r["chunks"]]
    lines = ["\t".join([place, "" if score is None else f"{score:.2f}", name or ""]).rstrip("\t") for place, score, name in rows]
    return "\n".join([*lines, _foot(r["summary"])])


def _xml(r: dict, verbose: bool) -> str:
    s = r["summary"]
    lines = ["<context>", f"  <meta {attributes(files=len(r['files']), chunks=len(r['chunks']), lines=s['total_lines'], tokens=s['total_tokens'])}/>"]
    for f in r["files"]:
        lines += [f"  <file {attributes(path=f['path'], reason=f['reason'], score=f'{f['score']:.2f}' if verbose and f.get('score') is not None else None)}>", escape(f["content"]), "  </file>"]
    for c in r["chunks"]:
        lines += [f"  <chunk {attributes(path=c['path'], lines=f'{c['start_line']}-{c['end_line']}', name=c['name'] or None, score=f'{c['score']:.2f}')}>", escape(c["content"]), "  </chunk>"]
    return "\n".join([*lines, "</context>", _foot(s)])


def _compact(r: dict, verbose: bool) -> str:
    lines = []
    for f in r["files"]:
        lines += [f"## {f['path']}" + (f" ({f['reason']})" if verbose else ""), "```" + f["path"].rpartition(".")[2], f["content"], "```", ""]
    for c in r["chunks"]:
        lines += [f"## {c['path']}:{c['start_line']}-{c['end_line']}", "```" + c["path"].rpartition(".")[2], c["content"], "```", ""]
    return "\n".join([*lines, _foot(r["summary"])])


def _chunks(r: dict, verbose: bool) -> str:
    whole = [{**f, "start_line": 1, "end_line": f["content"].count("\n") + 1, "name": "", "score": f.get("score") or 1.0} for f in r["files"]]
    lines = ["<context>"]
    for c in [*whole, *r["chunks"]]:
        kind = {"score_type": "bm25plus"} if verbose else {}
        lines += [f"  <chunk {attributes(path=c['path'], lines=f'{c['start_line']}-{c['end_line']}', name=c['name'] or None, score=f'{c['score']:.2f}', **kind)}>", "```" + c["path"].rpartition(".")[2], c["content"], "```", "  </chunk>"]
    return "\n".join([*lines, "</context>", _foot(r["summary"])])


def _foot(s: dict) -> str:
    """What of the summary row has a value, field by field."""
    shown = {k: v for k, v in s.items() if v is not None and v is not False and k not in ("limit", "offset", "suggestion")}
    return f"<!-- {' '.join(f'{k}={v}' for k, v in shown.items())}{' ' + s['suggestion'] if s.get('suggestion') else ''} -->"


def _place(r: dict) -> dict:
    return {"path": r["file_path"] if "file_path" in r else r["path"], "lines": f"{r['start_line']}-{r['end_line']}" if r.get("start_line") is not None else None, "name": r.get("name") or None}


def _code(r: dict) -> list[str]:
    path = r["file_path"] if "file_path" in r else r["path"]
    return ["```" + path.rpartition(".")[2], r["content"], "```"]


def _sections(title: str, parts: dict[str, list[str]]) -> str:
    """Markdown: a title and the parts that hold something."""
    return "\n".join([f"# {title}", *(line for name, lines in parts.items() if lines for line in ["", f"## {name}", *lines])])


def find(query: str, found: list[dict], total: int, form: str = "xml") -> str:
    if form == "compact":
        return "\n".join([f"# {query}", *(line for r in found for line in ["", f"## {r['file_path']}:{r['start_line']}-{r['end_line']} {r['name']} {r['score']:.2f}", *_code(r)]), "", f"{len(found)} of {total}"])
    lines = [f"<implementations {attributes(query=query, total=total)}>"]
    for r in found:
        lines += [f"  <impl {attributes(**_place(r), score=f'{r['score']:.2f}', score_type='bm25plus')}>", *_code(r), "  </impl>"]
    return "\n".join([*lines, "</implementations>"])


def explain(x: dict, form: str = "xml") -> str:
    target = {"path": x["path"], "start_line": x["start_line"], "end_line": x["end_line"], "name": x["name"], "content": x["content"]}
    if form == "compact":
        related = [line for r in x["related"] for line in [f"### {r['file_path']}:{r['start_line']}-{r['end_line']} {r['name']}".rstrip(), *_code(r)]]
        return _sections(x["path"], {f"Target {x['name']}".rstrip(): _code(target), "Imports": [f"- {p}" for p in x["imports"]], "Imported by": [f"- {p}" for p in x["importers"]], "Related": related})
    lines = ["<explanation>", f"  <target {attributes(**_place(target))}>", *_code(target), "  </target>"]
    for tag, paths in (("imports", x["imports"]), ("imported_by", x["importers"])):
        lines += [f"  <{tag}>", *(f"    <file {attributes(path=p)}/>" for p in paths), f"  </{tag}>"] if paths else []
    if x["related"]:
        lines += ["  <related>", *(line for r in x["related"] for line in [f"    <chunk {attributes(**_place(r))}>", *_code(r), "    </chunk>"]), "  </related>"]
    return "\n".join([*lines, "</explanation>"])


def impact(target: str, function: str | None, found: list[dict], form: str = "xml") -> str:
    kinds = {k: sorted((r["path"] for r in found if r["kind"] == k)) for k in ("direct", "transitive")}
    if form == "compact":
        return _sections(f"Impact of {target}{f' ({function})' if function else ''}: {len(found)}", {k.capitalize(): [f"- {p}" for p in v] for k, v in kinds.items()})
    lines = [f"<impact {attributes(target=target, function=function, total_affected=len(found))}>"]
    for k, v in kinds.items():
        lines += [f"  <{k}ly_affected {attributes(count=len(v))}>", *(f"    <file {attributes(path=p)}/>" for p in v), f"  </{k}ly_affected>"]
    return "\n".join([*lines, "</impact>"])


def discovery(entry: str, nodes: list[dict], related: list[dict], form: str = "xml") -> str:
    if form == "compact":
        graph = [line for n in nodes for line in [f"- {n['path']}", *(f"  - {word} {p}" for word, ps in (("imports", n["imports"]), ("imported by", n["imported_by"])) for p in ps)]]
        return _sections(f"Discovery from {entry}: {len(nodes)} files", {"Graph": graph, "Related": [f"- {r['file_path']}:{r['start_line']}-{r['end_line']} {r['name']}".rstrip() for r in related]})
    lines = [f"<discovery {attributes(entry=entry, total_files=len(nodes))}>", "  <dependency_graph>"]
    lines += [f"    <file {attributes(path=n['path'], imports=','.join(n['imports']), imported_by=','.join(n['imported_by']))}/>" for n in nodes]
    lines += ["  </dependency_graph>", "  <related>", *(f"    <chunk {attributes(**_place(r))}/>" for r in related), "  </related>"] if related else ["  </dependency_graph>"]
    return "\n".join([*lines, "</discovery>"])


def search(query: str, found: list[dict]) -> str:
    lines = [f"<search_results {attributes(query=query, count=len(found))}>"]
    for r in found:
        place = _place(r)
        lines += [f"  <result {attributes(file=place.pop('path'), **place, score=round(r['score'], 3))}>", f"    <preview>{escape(r['content'][:500])}</preview>", "  </result>"]
    return "\n".join([*lines, "</search_results>"])


def grep(pattern: str, regex: bool, found: list[dict]) -> str:
    lines = [f"<grep_results {attributes(pattern=pattern, mode='regex' if regex else 'literal', count=len(found))}>"]
    for r in found:
        lines += [f"  <match {attributes(file=r['file'], line=r['line'])}>", f"    <text>{escape(r['match'])}</text>", f"    <context>{escape(r['context'])}</context>", "  </match>"]
    return "\n".join([*lines, "</grep_results>"])


def probe(found: dict) -> str:
    missing = found["missing"]
    lines = [f"<probe_result {attributes(status='incomplete' if missing else 'complete', missing_count=found['count'])}>"]
    lines += [f"  <suggestion {attributes(symbol=m['symbol'], file=m['file'], name=m['name'] or None, line=m['line'])}>{escape(m['suggestion'])}</suggestion>" for m in missing]
    lines += [f"  <defined>{escape(d)}</defined>" for d in found["defined"]]
    return "\n".join([*lines, "</probe_result>"])


def audit(found: list[dict], skeleton: bool) -> str:
    total, advice = (found[0]["total"], found[0]["advice"]) if found else (0, "")
    lines = [f"<audit_result {attributes(total_tokens=total, total_files=len(found), total_lines=sum(r['lines'] for r in found), skeleton_mode=str(skeleton).lower())}>", f"  <recommendation>{escape(advice)}</recommendation>"]
    return "\n".join([*lines, *(f"  <file {attributes(path=r['path'], tokens=r['tokens'], lines=r['lines'], reason=r['reason'])}/>" for r in found), "</audit_result>"])


def rows(name: str, found: list[dict], body: str | None = None) -> str:
    """A list of records as XML; ``body`` names the field that is the element's text."""
    lines = [f'<{name}s count="{len(found)}">']
    for r in found:
        attrs = attributes(**{k: v for k, v in r.items() if k != body and not isinstance(v, (list, dict))})
        lines.append(f"  <{name} {attrs}/>" if body is None else f"  <{name} {attrs}>{escape(r[body])}</{name}>")
    return "\n".join([*lines, f"</{name}s>"])


def table(found: list[dict], columns: list[str]) -> str:
    cells = [columns, *([str(r.get(c, "")) for c in columns] for r in found)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells)


def tree(nodes: list[dict], signatures: dict[str, list[str]], root: str) -> str:
    """Folders before files, both by name; signatures below their file."""
    inside: dict[str, list[dict]] = {}
    for n in nodes:
        inside.setdefault(n["parent"], []).append(n)
    lines = [f"{root}/"]

    def walk(parent: str, prefix: str) -> None:
        below = sorted(inside.get(parent, []), key=lambda n: (n["is_file"], n["name"].lower()))
        for i, n in enumerate(below):
            last = i + 1 == len(below)
            lines.append(f"{prefix}{'└── ' if last else '├── '}{n['name']}{'' if n['is_file'] else '/'}")
            deeper = prefix + ("    " if last else "│   ")
            lines.extend(f"{deeper}  {s}" for s in signatures.get(n["path"], []))
            if not n["is_file"]:
                walk(n["path"], deeper)

    walk("", "")
    return "\n".join(lines)
