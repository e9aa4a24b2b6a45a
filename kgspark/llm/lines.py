"""Removal of lines that several documents share, in DataFrame functions alone.

Method: every text is split at line feeds; a line's key (stripped of white space, A-Z lower-cased) is hashed to 128 bits
and goes out as (document, place, hash), without its text.  Documents are counted by hash in two steps, first to one row
for each hash and doc_id, then to one for each hash; both combine before they shuffle, so a line of every document is a
few rows for each task.  Places of lines to drop come from joining the lines with the common hashes: hashes of more than
a HEAVY_SHARE-th of all lines (so at most HEAVY_SHARE of them) are broadcast, the others join by hash.  Each document gets
the set of its places to drop, in one exchange of the texts, and its other lines are joined again by place.

Cases: null or empty text: one empty line, which stays; a null text stays null.  A document is a doc_id: rows of one doc_id don't
count as several documents, and none loses lines to another.  Null doc_id: all such rows are one document, behind all
numbers.  Repeated rows: a row each, treated alike.  Ties: the smallest doc_id keeps all its repeats of a line.  Empty
table: no rows.  Very long texts: whole; work is linear in lines.  Further columns of documents are returned as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import documents, free_names, stage

#: Code points of the shortest key that is looked at, and documents from which on it is common.
LEAST_CHARS = 10
LEAST_DOCUMENTS = 2
#: Lines of a hash from which it is broadcast: at least, and as a share of all lines.
HEAVY_LINES = 1000
HEAVY_SHARE = 10_000

WHITE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; lower() is quicker and the same on ASCII."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashes(*columns: Column) -> list[Column]:
    """128 bits in two numbers."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def keyed_lines(docs: DataFrame, text: str, least_chars: int) -> DataFrame:
    """d1, d2 (the document's hash), doc_id, place, h1, h2 of every line with a key long enough."""
    d1, d2 = hashes(F.col("doc_id").cast("long"), F.col(f"`{text}`"))
    # keys are made inside the array, so each is made once
    lines = docs.select(d1.alias("d1"), d2.alias("d2"), F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.transform(lines_of(text), key_of)).alias("place", "key"))
    h1, h2 = hashes(F.col("key"))
    return lines.filter(F.char_length("key") >= least_chars).select("d1", "d2", "doc_id", "place", h1.alias("h1"), h2.alias("h2"))


def common_hashes(lines: DataFrame, least_documents: int) -> DataFrame:
    """h1, h2, first (the smallest doc_id), lines (how many) of hashes in least_documents documents or more."""
    each = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    found = each.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"), F.sum("n").alias("lines"))
    return found.filter(F.col("documents") >= least_documents).drop("documents")


def places_to_drop(lines: DataFrame, common: DataFrame, heavy_lines: int = HEAVY_LINES) -> DataFrame:
    """d1, d2, gone (places): the lines of common hashes, but for those of the first document."""
    limit = max(heavy_lines, lines.count() // HEAVY_SHARE)
    # lines / limit hashes at most
    heavy = F.broadcast(common.filter(F.col("lines") > limit))
    light = common.filter(F.col("lines") <= limit)
    on = ["h1", "h2"]
    met = lines.join(heavy, on).unionByName(lines.join(heavy, on, "left_anti").join(light, on))
    return met.filter(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("d1", "d2").agg(F.collect_set("place").alias("gone"))


def without_common_lines(docs: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, heavy_lines: int = HEAVY_LINES) -> DataFrame:
    """docs, the text without common lines, and two more columns: how many lines it had, and how many were dropped
    (n_lines, n_dropped; with underscores behind if docs has such columns)."""
    lines = stage(keyed_lines(docs, text, least_chars), "lines")
    common = stage(common_hashes(lines, least_documents), "common-lines")
    gone = places_to_drop(lines, common, heavy_lines)
    rest, own, null, d1, d2, none, n_lines, n_dropped = free_names(docs, "rest", "own_lines", "null_text", "d1", "d2", "none", "n_lines", "n_dropped")
    a, b = hashes(F.col("doc_id").cast("long"), F.col(f"`{text}`"))
    # texts travel once, as lines; being cut before the join, the expressions behind it find an array and don't cut again
    others = F.struct(F.lit(0).alias(none), *[F.col(f"`{c}`") for c in docs.columns if c != text])
    cut = docs.select(others.alias(rest), lines_of(text).alias(own), F.col(f"`{text}`").isNull().alias(null), a.alias(d1), b.alias(d2))
    met = cut.join(gone.toDF(d1, d2, "gone"), [d1, d2], "left")
    size = F.size(own)
    places = F.array_except(F.sequence(F.lit(0), size - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col(own)).otherwise(F.transform(places, lambda place: F.element_at(own, place + 1)))
    joined = F.when(~F.col(null), F.array_join(kept, "\n"))
    columns = [joined.alias(c) if c == text else F.col(f"{rest}.`{c}`") for c in docs.columns]
    return met.select(*columns, size.cast("long").alias(n_lines), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_dropped))


def op12_line_dedup(spark, sf_dir):
    kept = without_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same in DuckDB's SQL.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {LEAST_DOCUMENTS}
),
flagged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.first AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY r
"""
