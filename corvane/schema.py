"""Explicit schemas of what the engine stores and returns; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: Of the stored index; another number means that it is rebuilt.
VERSION = 3


def _s(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


FILES = "path string, mtime double, length bigint, content string"
CHUNKS = "id string, file_path string, content string, start_line int, end_line int, name string, node_type string, last_modified double"
POSTINGS = "term string, chunk_id string, dl int"
TRIGRAMS = "trigram string, content_hash string"
HITS = "id string, file_path string, content string, start_line int, end_line int, name string, node_type string, score double"
GREP_HITS = "file string, line int, match string, context string"
EDGES = "src string, dst string, ord int"
SIGNATURES = "path string, sigs array<struct<text: string, depth: int>>, error string"
