"""License scans by diagonal voting, in DataFrame functions only.

Every rolling k-gram of words of every text is joined, by hash, to the positions of license templates
that hold the same k-gram. A match votes for its diagonal (text position less template position); the
votes of neighbouring diagonals, which an inserted or deleted word sets apart, are merged, and a span
is accepted if the words found cover enough of the template. How far apart neighbours may be grows with
the template, so a whole license is found with holders and clauses put in or left out. A short template
(a phrase) asks for each of its words in place, which makes its spans exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.license_texts import WHOLE

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # what parts words
SHORT, K_SHORT, K_LONG = 8, 2, 4  # K_LONG is twice K_SHORT, which is a power of two
WORDS_A_SLACK = 16  # of a template, for each diagonal that its neighbours may be apart
MARK = -1  # stands in for a hash; it only ever meets the row of k = 0


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), self.text))

    def reach(self, slack: int) -> int:
        """How far apart neighbouring diagonals may be; far less than two copies of the template are."""
        return max(slack, len(self.words) // WORDS_A_SLACK)


# The phrases of the contract, sentences of well-known license texts, and whole texts.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("apache-2.0", "apache license version 2 0"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("bsd", "bsd 3 clause license"),
    Template("mpl-2.0", "mozilla public license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    *(Template(label, text) for label, text in WHOLE),
)


def _template_grams(spark, templates: tuple[Template, ...], slack: int) -> DataFrame:
    """(h, gram, t, label, base, at, grams, k, reach): one row per k-gram of a template; its size is fixed by the parameter."""
    rows = []
    for t, x in enumerate(templates):
        words = x.words
        k = K_SHORT if len(words) <= SHORT else K_LONG
        if len(words) < K_SHORT:
            raise ValueError(f"a template needs {K_SHORT} words: {x.text!r}")
        for at in range(len(words) - k + 1):
            gram = ", ".join(f"'{w}'" for w in words[at : at + k])
            rows.append(f"({_gram_hash(words[at : at + k])}, array({gram}), {t}, '{x.label}', {str(x.base).lower()}, {at}, {len(words) - k + 1}, {k}, {x.reach(slack)})")
    rows.append(f"({MARK}L, array(''), -1, '', false, 0, 1, 0, 0)")  # the row that each text meets once
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v(h, gram, t, label, base, at, grams, k, reach)")


def _gram_hash(words: tuple[str, ...]) -> str:
    """SQL for the hash of a k-gram, k a power of two: halves are hashed, then both hashes together."""
    half = len(words) // 2
    return f"xxhash64({_gram_hash(words[:half])}, {_gram_hash(words[half:])})" if half else f"xxhash64('{words[0]}')"


def _exploded_grams(rows: DataFrame) -> DataFrame:
    """rows (words, ...), once for each k-gram: its place at_gram and hash h, the short ones first, led by the mark that every text has.

    Each word is hashed once; a longer gram is the hash of its halves' hashes. Each step is a column of
    its own, so that none is worked out twice; their union is none, since a filter on its size would be
    pushed below the steps and work them all out again.
    """

    def paired(half: str, k: int) -> Column:
        n = F.greatest(F.size("words") - (k - 1), F.lit(0))
        return F.zip_with(F.slice(half, 1, n), F.slice(half, 1 + k // 2, n), lambda a, b: F.xxhash64(a, b))

    steps = rows.withColumn("__one", F.transform("words", lambda w: F.xxhash64(w)))
    steps = steps.withColumn("__short", paired("__one", K_SHORT)).withColumn("__long", paired("__short", K_LONG))
    return steps.select(*rows.columns, F.posexplode(F.concat(F.array(F.lit(MARK).cast("long")), "__short", "__long")).alias("at_gram", "h"))


def _lowered(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but never into ASCII: the Kelvin sign, which would, is another letter first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0137")))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, slack: int = 2, cover: float = 0.6) -> DataFrame:
    """Accepted spans: doc_id, text_hash, n_words, rows, t, label, base, first, last, places, coverage.

    Each text also has one span with t = -1 that only carries n_words and the number of its rows.
    first and last are starts of the first and last place (word positions from 0). Diagonals at most
    `slack` apart, or a 16th of a longer template's words, are one place; templates of up to SHORT words need every word, longer ones `cover`
    of their k-grams. Null text counts as empty.
    """
    grams = _template_grams(docs.sparkSession, templates, slack)
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.array_remove(F.split(_lowered(F.col(text_col)), BETWEEN), "").alias("words"))
    n = F.size("words")
    shorts = F.greatest(n - (K_SHORT - 1), F.lit(0))  # their number
    i = F.when(F.col("k") == K_SHORT, F.col("at_gram") - 1).when(F.col("k") == K_LONG, F.col("at_gram") - 1 - shorts).otherwise(0)
    in_part = F.when(F.col("at_gram") == 0, 0).when(F.col("at_gram") <= shorts, K_SHORT).otherwise(K_LONG) - F.col("k") == 0  # a condition, so that the hash alone is the key
    votes = (
        _exploded_grams(words)
        .join(F.broadcast(grams), "h")
        # equal hashes are not yet equal words
        .filter(in_part & ((F.col("k") == 0) | (F.slice("words", i + 1, F.greatest("k", F.lit(1))) == F.col("gram"))))
        .select("doc_id", "text_hash", n.cast("long").alias("n_words"), "t", "label", "base", "grams", "k", "reach", "at", (i - F.col("at")).alias("diagonal"))
    )
    diagonals = votes.groupBy("doc_id", "text_hash", "t", "diagonal").agg(
        F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"), F.first("k").alias("k"), F.first("reach").alias("reach"), F.collect_set("at").alias("ats"), F.count("*").alias("rows")
    )
    along = Window.partitionBy("doc_id", "text_hash", "t").orderBy("diagonal")
    exact = F.col("k") == K_SHORT
    new = F.col("diagonal") - F.lag("diagonal").over(along) <= F.when(exact, -1).otherwise(F.col("reach"))
    places = (
        diagonals.withColumn("new", F.when(new, 0).otherwise(1))
        .withColumn("place", F.sum("new").over(along))
        .groupBy("doc_id", "text_hash", "t", "place")
        .agg(
            F.first("n_words").alias("n_words"),
            F.first("label").alias("label"),
            F.first("base").alias("base"),
            F.max("rows").alias("rows"),
            F.min("diagonal").alias("start"),
            (F.size(F.array_distinct(F.flatten(F.collect_list("ats")))) / F.first("grams")).alias("coverage"),
            F.first("k").alias("k"),
        )
        .filter(F.col("coverage") >= F.when(F.col("k") == K_SHORT, 1.0).otherwise(cover))
    )
    return places.groupBy("doc_id", "text_hash", "t").agg(
        F.first("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.max("rows").alias("rows"),
        F.min("start").cast("long").alias("first"),
        F.max("start").cast("long").alias("last"),
        F.count("*").alias("places"),
        F.max("coverage").alias("coverage"),
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base templates are phrases; their places are exact. score is the largest share of a template that
    a text covers (0 without any). Null or empty texts have no words and no labels; rows that repeat
    identifier and text each get the same row; a null identifier is kept as such.
    """
    spans = license_spans(docs, id_col, text_col, templates)
    base, found = F.col("base"), F.col("t") >= 0
    out = spans.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("last"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.max(F.when(~found, F.col("rows"))).alias("rows"),
    )
    return out.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("rows", "again", "text_hash")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses of every document: null and empty texts have none, repeated rows come out repeated."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(templates: tuple[Template, ...] = TEMPLATES, slack: int = 2, cover: float = 0.6) -> str:
    """The same scan as plain SQL over words, without hashes."""
    values = []
    for t, x in enumerate(templates):
        words = x.words
        k = K_SHORT if len(words) <= SHORT else K_LONG
        values += [f"({t}, '{x.label}', {str(x.base).lower()}, {at}, {len(words) - k + 1}, {k}, {x.reach(slack)}, '{' '.join(words[at : at + k])}')" for at in range(len(words) - k + 1)]
    return f"""
WITH g(t, label, base, pos, grams, k, reach, gram) AS (VALUES {', '.join(values)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
w AS (SELECT doc_id, u.word AS word, u.i - 1 AS i FROM d, unnest(words) WITH ORDINALITY AS u(word, i)),
r AS (SELECT doc_id, i, word AS w0, lead(word, 1) OVER v AS w1, lead(word, 2) OVER v AS w2, lead(word, 3) OVER v AS w3 FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
votes AS (
  SELECT doc_id, i - pos AS diagonal, g.* FROM r JOIN g ON k = {K_SHORT} AND w0 || ' ' || w1 = gram
  UNION ALL SELECT doc_id, i - pos AS diagonal, g.* FROM r JOIN g ON k = {K_LONG} AND w0 || ' ' || w1 || ' ' || w2 || ' ' || w3 = gram
),
m AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER v <= CASE WHEN k = {K_SHORT} THEN 0 ELSE reach END THEN 0 ELSE 1 END AS fresh
  FROM votes WINDOW v AS (PARTITION BY doc_id, t ORDER BY diagonal, pos)
),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY diagonal, pos) AS place FROM m),
places AS (
  SELECT doc_id, t, place, any_value(label) AS label, any_value(base) AS base, min(diagonal) AS start, count(DISTINCT pos) / CAST(any_value(grams) AS DOUBLE) AS coverage, any_value(k) AS k
  FROM p GROUP BY doc_id, t, place
),
good AS (SELECT * FROM places WHERE coverage >= CASE WHEN k = {K_SHORT} THEN 1.0 ELSE {cover} END),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM good GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
