"""Line deduplication by overlapping three-line windows (operator 8).

Each text is split at ``\\n``; lines without a word are skipped. Every three consecutive lines form a window, hashed
to 128 bits. A window that occurs more than once in the corpus keeps its first occurrence (smallest doc_id, then
position); later ones are removed, and overlapping windows merge, as what goes is the union of the covered lines. A
later occurrence that overlaps the first one takes lines of it away too: of one line five times in a row, one stays.

Defined cases: texts of fewer than three lines with words have no window and stay; null texts stay null; rows that
repeat one doc_id with one text are one document and are treated alike; null ids come last in the order; columns
other than doc_id and text pass through ``dedup_lines`` untouched, whatever their names, but for any ``_n_lines`` and
``_n_removed``, which the counts replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, read_table, stage

WINDOW = 3
_WORD = r"[^\x20\x09-\x0D]"


def _rid():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, h, at array<int>): every window of the texts, with its three line positions."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda x: x["l"].rlike(_WORD))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    some = some.select("doc_id", _rid().alias("rid"), lines.alias("ls")).where(F.size("ls") >= WINDOW)

    def window(j):
        ls = F.slice("ls", j + 1, WINDOW)
        return F.struct(F.unhex(F.md5(F.array_join(ls["l"], "\n"))).alias("h"), ls["i"].alias("at"))

    return some.select("doc_id", "rid", F.explode(F.transform(F.sequence(F.lit(0), F.size("ls") - WINDOW), window)).alias("w")).select("doc_id", "rid", "w.h", "w.at")


def later_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, gone array<int>): positions of the lines that later occurrences cover."""
    w = stage(windows(docs), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", F.col("at")[0].alias("i"))
    first = w.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h", "first")
    first = stage(first, "repeated-windows")
    later = w.join(first, "h").where(place != F.col("first"))
    return later.select("doc_id", "rid", F.explode("at").alias("i")).groupBy("doc_id", "rid").agg(F.collect_set("i").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` deduplicated, and the counts ``_n_lines`` and ``_n_removed`` added."""
    gone = later_lines(docs)
    own = beside(docs, docs.columns, docs["doc_id"].cast("long").alias("own_id"), docs["text"].cast("string").alias("own_text"))
    own = own.withColumn("own_rid", F.xxhash64(F.coalesce(F.col("_keep")["doc_id"].cast("string"), F.lit("null")), "own_text"))
    own = own.select("_keep", "own_id", "own_rid", F.split("own_text", "\n", -1).alias("lines"))  # below the join: split once, not once for each line
    got = own.join(gone, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_rid") == F.col("rid")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # by hash, so in time proportional to the lines
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(kept)
    counts = F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(0).cast("long").alias("_n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_n_removed")
    others = [c for c in docs.columns if c.lower() not in ("_n_lines", "_n_removed")]
    return got.select(*[text.alias(c) if c.lower() == "text" else F.col("_keep")[c].alias(c) for c in others], *counts)


def op8_linededup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


OP8_SQL = r"""
WITH parted AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS l FROM parted),
windows AS (
  SELECT doc_id, i,
         lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2,
         l || chr(10) || lead(l, 1) OVER w || chr(10) || lead(l, 2) OVER w AS win
  FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM windows WHERE win IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest([i, i1, i2]) AS i FROM ranked WHERE nth > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         string_agg(l.l, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
