"""The engine's queries as tools for other programs: each takes a root and plain values and returns text.

``serve`` answers JSON-RPC requests, one a line: ``initialize``, ``tools/list`` and ``tools/call``, as tool protocols have them.
"""

from __future__ import annotations

import inspect
import json
import os
import time
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import SparkSession

from ..errors import CorvaneError
from . import render
from .engine import Engine

_KINDS = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}


class Tools:
    """One engine per root, with its index below ``stores``."""

    NAMES = ("pack", "map", "search", "grep", "index", "probe", "impact", "audit")

    def __init__(self, spark: SparkSession, stores: str):
        self.spark, self.stores, self._engines = spark, stores.rstrip("/"), {}

    def _engine(self, root: str) -> Engine:
        if "://" not in root and not os.path.isdir(root):
            raise CorvaneError("INVALID_PATH", "the root is no folder", path=root)
        at = root.rstrip("/")
        if at not in self._engines:
            self._engines[at] = Engine.over(self.spark, at, f"{self.stores}/{index_name(at)}")
        return self._engines[at]

    def pack(self, root: str, focus: str | None = None, query: str | None = None, max_files: int = 10, import_depth: int = 2, format: str = "compact", focus_only: bool = False, skeleton: bool = True) -> str:
        """Code around a file and about a query, ready to read."""
        found = self._engine(root).pack(focus, query, max_files=max_files, max_chunks=15, import_depth=import_depth, chunk_mode=not focus_only, skeleton=skeleton, focus_only=focus_only)
        return render.pack(found, format if focus_only else "chunks")

    def map(self, root: str, include_signatures: bool = True, max_sigs: int | None = None) -> str:
        """The tree of folders and files, with signatures."""
        return self._engine(root).map("tree", include_signatures, max_sigs)

    def search(self, root: str, query: str, limit: int = 10, min_score: float | None = None) -> str:
        """Chunks ranked for a query."""
        e = self._engine(root)
        e.index()
        return render.search(query, [r.asDict() for r in e.search(query, limit, min_score).collect()])

    def grep(self, root: str, pattern: str, regex: bool = False, limit: int = 20) -> str:
        """Places that hold a text or fit an expression."""
        return render.grep(pattern, regex, [r.asDict() for r in self._engine(root).grep(pattern, regex, limit).collect()])

    def index(self, root: str, force: bool = False) -> str:
        """Bring the index up to date."""
        began, e = time.time(), self._engine(root)
        done = e.index(force)
        return f"<index_result {render.attributes(status=done['status'], chunks_indexed=done['chunks'], seconds=round(time.time() - began, 2), index_path=e.store.root)}/>"

    def probe(self, root: str, content: str, limit: int = 10) -> str:
        """What a text uses without defining it, and where that may be."""
        return render.probe(self._engine(root).probe(content, limit))

    def impact(self, root: str, file: str, function: str | None = None, max_depth: int = 3) -> str:
        """What a change of a file may touch."""
        e = self._engine(root)
        path = e.inside(file)
        return render.impact(path, function, [r.asDict() for r in e.impact(path, max_depth, function=function).collect()])

    def audit(self, root: str, focus: str | None = None, query: str | None = None, max_files: int = 10, import_depth: int = 2, skeleton: bool = False) -> str:
        """What a pack would cost."""
        return render.audit(self._engine(root).audit(focus=focus, query=query, max_files=max_files, import_depth=import_depth, skeleton=skeleton), skeleton)

    def call(self, name: str, values: dict[str, Any]) -> str:
        """A tool's text; errors come as text too."""
        if name not in self.NAMES:
            raise KeyError(name)
        try:
            return getattr(self, name)(**values)
        except CorvaneError as e:
            return e.as_xml()


def index_name(root: str) -> str:
    import hashlib

    return hashlib.sha256(os.path.abspath(root).encode() if "://" not in root else root.encode()).hexdigest()[:16]


def described(f: Callable) -> dict:
    """A tool's name, purpose and parameters, from its signature."""
    taken = {k: p for k, p in inspect.signature(f).parameters.items() if k != "self"}
    kinds = {k: {"type": _KINDS[str(p.annotation).split(" ")[0]], **({} if p.default in (p.empty, None) else {"default": p.default})} for k, p in taken.items()}
    return {"name": f.__name__, "description": inspect.getdoc(f), "inputSchema": {"type": "object", "properties": kinds, "required": [k for k, p in taken.items() if p.default is p.empty]}}


def answer(tools: Tools, request: dict) -> dict | None:
    """The response to one request; none to a notification."""
    method, given, number = request.get("method"), request.get("params") or {}, request.get("id")
    if number is None:
        return None
    said: dict[str, Any] = {"jsonrpc": "2.0", "id": number}
    try:
        if method == "initialize":
            return {**said, "result": {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "corvane", "version": "0.2"}}}
        if method == "tools/list":
            return {**said, "result": {"tools": [described(getattr(Tools, n)) for n in Tools.NAMES]}}
        if method == "tools/call":
            text = tools.call(given["name"], given.get("arguments") or {})
            return {**said, "result": {"content": [{"type": "text", "text": text}], "isError": text.startswith("<error ")}}
        return {**said, "error": {"code": -32601, "message": f"no such method: {method}"}}
    except (KeyError, TypeError) as e:
        return {**said, "error": {"code": -32602, "message": f"bad parameters: {e}"}}
    except Exception as e:  # a tool that fails must not end the server
        return {**said, "error": {"code": -32603, "message": str(e)}}


def serve(tools: Tools, asked: IO[str], answered: IO[str]) -> None:
    for line in asked:
        if not line.strip():
            continue
        try:
            said = answer(tools, json.loads(line))
        except ValueError:
            said = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if said is not None:
            answered.write(json.dumps(said) + "\n")
            answered.flush()
