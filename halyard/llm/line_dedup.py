"""Line dedup over overlapping windows of three lines.

Every three consecutive lines that are not blank make a window. A window seen before, in this document
or an earlier one by identifier, covers its lines; covered lines go. The first occurrence stays, so
some copy of each line always remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _entries(text: Column) -> Column:
    """The lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def _windows(entries: Column) -> Column:
    def window(i: Column) -> Column:
        part = [F.get(entries, i + j) for j in range(WINDOW)]
        return F.struct(F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(WINDOW), *part[::-1]).alias("h2"), i.alias("at"))

    return F.when(F.size(entries) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(entries) - WINDOW), window))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, covered): the sorted positions, among the lines that are not blank, that later occurrences cover.

    Only documents with such lines are in it. The shuffles carry two hashes and a position per window;
    frequent windows are counted before they are shuffled, and their rows meet the counts in a join
    that may be split.
    """
    windows = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), _entries(F.col("text")).alias("entries"))
        .select("doc_id", "text_hash", F.explode(_windows(F.col("entries"))).alias("w"))
        .select("doc_id", "text_hash", "w.h1", "w.h2", "w.at")
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "at")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    return (
        windows.join(repeated, ["h1", "h2"])
        .filter(place != F.col("first"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("at").alias("ats"))
        .select("doc_id", "text_hash", F.array_sort(F.array_distinct(F.flatten(F.transform("ats", lambda p: F.sequence(p, p + WINDOW - 1))))).alias("covered"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that repeat earlier windows taken out of text_col, and n_lines, n_removed, removed_spans beside it.

    Lines are compared trimmed, blank lines take no part and stay. Occurrences are ordered by
    (identifier, position); a null identifier comes last. Null text counts as empty and comes out
    empty; texts of fewer than three lines stay as they are. Rows that repeat identifier and text are
    one document given twice and come out alike. Columns of docs named n_lines, n_removed or
    removed_spans are replaced; all others are kept.
    """
    key = {"__doc": F.col(id_col), "__hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    found = covered_lines(docs, id_col, text_col).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("covered").alias("__covered"))
    joined = docs.drop("n_lines", "n_removed", "removed_spans").withColumns(key)
    joined = joined.join(found, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__h")), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    covered = F.col("__covered")
    # index of each line that is not blank, so that a position among those leads to the line
    solid = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: F.trim(F.get("__lines", i)) != "")
    gone = F.transform(covered, lambda p: F.get("__solid", p))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone), lambda i: F.get("__lines", i))
    starts = F.array_except(covered, F.transform(covered, lambda p: p + 1))
    ends = F.array_except(covered, F.transform(covered, lambda p: p - 1))
    spans = F.array_join(F.zip_with(starts, ends, lambda a, b: F.concat_ws("-", a, b)), ",")
    return (
        joined.withColumn("__lines", lines)
        .withColumn("__solid", solid)
        .withColumns(
            {
                text_col: F.when(covered.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")),
                "n_lines": F.size("__solid").cast("long"),
                "n_removed": F.coalesce(F.size(covered), F.lit(0)).cast("long"),
                "removed_spans": F.coalesce(spans, F.lit("")),
            }
        )
        .drop("__doc", "__hash", "__d", "__h", "__covered", "__lines", "__solid")
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed", "removed_spans")


ORACLE = """
WITH lines AS (
  SELECT doc_id, u.line AS line, u.i AS i, trim(u.line, ' ') <> '' AS solid
  FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, i)
), solid AS (
  SELECT doc_id, i, trim(line, ' ') AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM lines WHERE solid
), win AS (
  SELECT doc_id, pos, s AS s0, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2 FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s0, s1, s2 ORDER BY doc_id, pos) AS r FROM win WHERE s2 IS NOT NULL) WHERE r > 1
), cov AS (
  SELECT DISTINCT doc_id, pos + j AS pos FROM later, (VALUES (0), (1), (2)) AS o(j)
), runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) AS b FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM cov) GROUP BY doc_id, g
), spans AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_spans, sum(b - a + 1) AS n_removed FROM runs GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM lines l LEFT JOIN solid s ON l.doc_id = s.doc_id AND l.i = s.i LEFT JOIN cov c ON s.doc_id = c.doc_id AND s.pos = c.pos
  WHERE c.pos IS NULL GROUP BY l.doc_id
), n AS (
  SELECT doc_id, count(*) FILTER (solid) AS n_lines FROM lines GROUP BY doc_id
)
SELECT n.doc_id, coalesce(k.text, '') AS text, CAST(n.n_lines AS BIGINT) AS n_lines, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed, coalesce(p.removed_spans, '') AS removed_spans
FROM n LEFT JOIN kept k ON n.doc_id = k.doc_id LEFT JOIN spans p ON n.doc_id = p.doc_id
"""
