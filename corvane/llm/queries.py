"""Queries of the problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import docpairs, leakage, packing, pii, provenance, splitting, termfreq, validity


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return termfreq.trigram_frequencies(_table(spark, sf, "trigrams"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_term_frequencies(spark, sf).filter(F.col("mark").isNotNull()).select("trigram", "mark")


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    return validity.fault_rates(validity.syntax_verdicts(_table(spark, sf, "files")))


def p2_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return validity.syntax_verdicts(_table(spark, sf, "files"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_verdicts(spark, sf).filter("faults > 0").select("file_id").distinct()


def p2_json(spark: SparkSession, sf: str) -> DataFrame:
    return p2_verdicts(spark, sf).filter("language = 'json' and faults > 0").select("file_id").distinct()


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.documented_functions(_table(spark, sf, "chunks"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pairs(spark, sf).select("id", "func_name").distinct()


def p3_go(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pairs(spark, sf).filter(F.col("language") == "go").select("id", "func_name").distinct()


def p4_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.provenance(_table(spark, sf, "files"))


def p4_containment(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.containment(_table(spark, sf, "files")).select("file_id", F.round("containment", 9).alias("containment"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_provenance(spark, sf).filter("reason is not null").select("file_id").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, sf, "chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pieces(spark, sf).select("id").distinct()


def p5_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each chunk put together again, and whether they keep to the limit and to their lines."""
    w = Window.partitionBy("id").orderBy("piece")
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n")))
    ends = F.when(F.endswith("content", F.lit("\n")), 1).otherwise(0)
    next_line = F.lead("start_line").over(w)
    p = p5_pieces(spark, sf).withColumn("kept", (F.col("end_line") - F.col("start_line") == lines - ends) & (next_line.isNull() | (next_line == F.col("end_line") + ends)))
    p = p.withColumn("kept", F.col("kept") & (F.length("content") + F.when(F.col("piece") > 0, F.length("context_prev")).otherwise(0) <= splitting.LIMIT))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "content"))), lambda x: x["content"]), "")
    return p.groupBy("id").agg(F.md5(whole).alias("md5"), F.bool_and("kept").alias("kept"))


def p6_windows(spark: SparkSession, sf: str) -> DataFrame:
    return packing.windows_of_documents(_table(spark, sf, "documents"))


def p6_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the windows keep what they promise, in one row: documents in them, windows over capacity, documents in parts without need, and use of room."""
    w = p6_windows(spark, sf)
    windows = w.groupBy("window_id").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("over"), (F.sum("used") >= 0.95 * packing.CAPACITY * (F.count_if(F.col("used") > 0) - 1)).alias("filled"))
    whole = w.groupBy("doc_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("parts"))
    split = F.count_if(F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / packing.CAPACITY)))
    return whole.agg(F.count("*").alias("documents"), split.alias("split")).join(F.broadcast(windows))


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).filter(F.col("run") >= leakage.RUN).select("doc_id", "item_id").distinct()


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf, "documents"), _table(spark, sf, "contributors"))


def p8_rest(spark: SparkSession, sf: str) -> DataFrame:
    """Each text made of its redaction again, by putting the mentions back where they stood: nothing else was changed."""
    placeholder = F.create_map(*(F.lit(x) for pair in pii.PLACEHOLDERS.items() for x in pair))
    back = F.aggregate("mentions", F.col("redacted"), lambda a, m: F.concat(F.substring(a, F.lit(1), m["start"]), m["value"], F.substring(a, m["start"] + F.length(placeholder[m["pii_type"]]) + 1, F.lit(1 << 30))))
    return p8_redacted(spark, sf).select("doc_id", F.md5(back).alias("md5"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.found_pii(_table(spark, sf, "documents"), _table(spark, sf, "contributors")).distinct()


QUERIES = {f.__name__: f for f in (p1_term_frequencies, p1_found, p2_verdicts, p2_rates, p2_json, p2_found, p3_pairs, p3_go, p3_found, p4_provenance, p4_containment, p4_found, p5_pieces, p5_rebuilt, p5_found, p6_windows, p6_filled, p7_leaks, p7_found, p8_redacted, p8_rest, p8_found)}

_COUNTED = "SELECT trigram, file_id, pos FROM trigrams WHERE file_id IS NOT NULL AND length(trigram) = 3"
_MARKED = f"""
WITH t AS ({_COUNTED}), n AS (SELECT count(DISTINCT file_id) AS every FROM t),
c AS (SELECT trigram, count(DISTINCT (file_id, pos)) AS occurrences, count(DISTINCT file_id) AS records FROM t GROUP BY trigram)
SELECT trigram, occurrences, records,
       CASE WHEN records = 1 THEN 'rare' WHEN records > 0.5 * every THEN 'common' END AS mark
FROM c, n"""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_TEXTS = f"d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS ws FROM eval_items WHERE text IS NOT NULL)"


def _strings(source: str, key: str, n: int) -> str:
    """Every ``n`` words in a row, with their place."""
    return f"(SELECT {key}, p, array_to_string(ws[p:p + {n - 1}], ' ') AS w FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {n - 2})) AS p FROM {source}))"


# nine of twelve words equal leave three in a row somewhere: these lead to all alignments that count
_LEAKS = f"""
WITH {_TEXTS},
x AS (SELECT DISTINCT doc_id, item_id, b.p - a.p AS diagonal FROM {_strings("d", "doc_id", 3)} a JOIN {_strings("i", "item_id", 3)} b USING (w)),
s AS (SELECT x.doc_id, item_id, diagonal, dp.p AS p, CAST(dp.w = ip.w AS INT) AS same FROM x JOIN {_strings("i", "item_id", 1)} ip USING (item_id) JOIN {_strings("d", "doc_id", 1)} dp ON dp.doc_id = x.doc_id AND dp.p = ip.p - diagonal),
w AS (SELECT *, sum(same) OVER o AS equal, count(*) OVER o AS n FROM s WINDOW o AS (PARTITION BY doc_id, item_id, diagonal ORDER BY p ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
g AS (SELECT doc_id, item_id, diagonal, p, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS stretch FROM w WHERE n = 12 AND equal >= 9),
o AS (SELECT doc_id, item_id, diagonal, min(p) AS first, max(p) + 11 AS last FROM g GROUP BY doc_id, item_id, diagonal, stretch),
r AS (SELECT doc_id, item_id, diagonal, first, last, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal, first ORDER BY p) AS island FROM o JOIN s USING (doc_id, item_id, diagonal) WHERE p BETWEEN first AND last AND same = 1),
l AS (SELECT doc_id, item_id, diagonal, first, last, count(*) AS run FROM r GROUP BY doc_id, item_id, diagonal, first, last, island)
SELECT doc_id, item_id, CAST(max(run) AS INT) AS run, CAST(max(last - first + 1) AS INT) AS overlap, CAST(arg_max(first, [last - first, -first]) - 1 AS INT) AS at_word FROM l GROUP BY doc_id, item_id"""

_CODE = "(SELECT DISTINCT ON (file_id) file_id, repo, path, content, regexp_matches(path, '{}', 'i') AS inside FROM files WHERE regexp_matches(content, '\\S') AND regexp_matches(lower(path), '\\.(py|js|mjs|ts|go|rs|java)$'))".format(provenance._FOLDERS)
_LINES = "list_distinct(list_filter(list_transform(regexp_split_to_array(content, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ' || chr(9))), lambda x: length(x) >= 12))"
def contained_sql(share: float) -> str:
    """Of each file outside of third-party folders the largest share of its lines in one file inside, by a join of all lines."""
    return f"""
WITH f AS {_CODE}, c AS (SELECT content, inside, min(repo) AS a, max(repo) AS z, {_LINES} AS ls FROM f GROUP BY content, inside),
l AS (SELECT content, inside, a, z, len(ls) AS n, unnest(ls) AS line FROM c),
s AS (SELECT o.content, t.content AS source, any_value(o.n) AS n, count(*) AS shared FROM l o JOIN l t USING (line) WHERE NOT o.inside AND t.inside AND (o.a <> o.z OR t.a <> t.z OR o.a <> t.a) GROUP BY 1, 2)
SELECT file_id, round(max(shared / n), 9) AS containment FROM f JOIN s USING (content) WHERE NOT inside AND shared / n >= {share} GROUP BY file_id"""


_GO = r"(?:(?:^[ \t]*//[^\n]*\n)+|^[ \t]*/\*(?:[^*]|\*+[^*/])*\*+/[ \t]*\n)[ \t]*func[ \t]*(?:\([^()]*\)[ \t]*)?\w+[ \t]*[\[(]"
# comment and head of each function that has one right above, the comment without its marks and lines for single parameters
_PAIRED = f"""
SELECT DISTINCT id, regexp_extract(pair, '(?s).*func[ \\t]*(?:\\([^()]*\\)[ \\t]*)?(\\w+)[ \\t]*[\\[(]$', 1) AS func_name FROM (
    SELECT id, unnest(regexp_extract_all(replace(content, chr(13), ''), '(?m){_GO}')) AS pair FROM chunks
    WHERE lower(regexp_replace(type, '\\s', '', 'g')) IN ('function', 'class') AND lower(file_path) LIKE '%.go')
WHERE len(flatten(list_transform(list_filter(list_transform(string_split(regexp_extract(pair, '(?s)^(.*)func', 1), chr(10)), lambda l: regexp_replace(trim(l, ' ' || chr(9)), '^(//[/!]?|/\\*+!?|\\*+)? ?', '')), lambda l: NOT regexp_matches(l, '^\\s*[@:]')),
    lambda l: list_filter(regexp_split_to_array(l, '\\s+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}_]'))))) >= 5"""

SQL = {
    # DuckDB lets commas before a closing bracket, NaN and Infinity pass
    "p2_json": r"""SELECT DISTINCT file_id FROM files WHERE lower(path) LIKE '%.json' AND regexp_matches(content, '\S')
        AND (NOT json_valid(content) OR regexp_matches(regexp_replace(content, '"(?:[^"\\]|\\.)*"', '""', 'g'), '(?i),\s*[\]}]|nan|inf'))""",
    "p3_go": _PAIRED,
    "p5_rebuilt": "SELECT DISTINCT id, md5(content) AS md5, true AS kept FROM chunks WHERE length(content) > 800",
    "p8_rest": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "p4_containment": contained_sql(provenance.CONTAINED),
    "p1_term_frequencies": _MARKED,
    "p1_found": f"SELECT trigram, mark FROM ({_MARKED}) WHERE mark IS NOT NULL",
    "p6_filled": "SELECT count(*) AS documents, 0 AS split, 0 AS over, true AS filled FROM documents WHERE text IS NOT NULL",
    "p7_found": f"WITH {_TEXTS} SELECT DISTINCT doc_id, item_id FROM {_strings('d', 'doc_id', 12)} JOIN {_strings('i', 'item_id', 12)} USING (w)",
    "p7_leaks": _LEAKS,
    "p5_found": "SELECT DISTINCT id FROM chunks WHERE length(content) > 800",
}
