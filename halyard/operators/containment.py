"""Which of very many patterns does a text contain? An inverted index instead of a scan of all patterns.

Each pattern is listed under one of its grams (substrings of GRAM characters), the one that fewest patterns
have, or under itself if it is shorter. A text that contains a pattern contains its gram, so texts meet
patterns by an equi-join on grams, and an exact test decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 5
MOST_BROADCAST = 200_000  # patterns; a row of the index has about 100 bytes


def _grams(text: Column, size: int) -> Column:
    n = F.char_length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def pattern_index(patterns: DataFrame, pattern: str, size: int = GRAM) -> DataFrame:
    """patterns with the gram under which each is listed; empty and null patterns, which nothing is asked about, are left out."""
    rows = patterns.filter(F.col(pattern) != "")
    grams = rows.select(pattern, F.explode(F.when(F.char_length(pattern) < size, F.array(pattern)).otherwise(_grams(F.col(pattern), size))).alias("gram")).distinct()
    rarity = grams.groupBy("gram").agg(F.count("*").alias("n"))
    best = grams.join(rarity, "gram").groupBy(pattern).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rows.join(best, pattern)


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, size: int = GRAM, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(key, columns of patterns) for each pattern that a text contains as a substring, once.

    Texts without a gram of any pattern meet nothing. The index is broadcast after a count, and shuffled
    where it has more than most_broadcast rows. key must tell texts apart.
    """
    index = pattern_index(patterns, pattern, size)
    lengths = sorted({size, *(r[0] for r in index.filter(F.char_length("gram") < size).select(F.char_length("gram")).distinct().collect())})  # at most `size` numbers
    if index.limit(most_broadcast + 1).count() <= most_broadcast:
        index = F.broadcast(index)
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col(text), n) for n in lengths])))
    rows = texts.select(F.col(key), F.col(text).alias("__text"), F.explode(grams).alias("gram"))
    met = rows.join(index, "gram").filter(F.contains("__text", F.col(pattern)))
    return met.select(key, *patterns.columns)


def first_contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, order: list[str], test: Column | None = None, **more) -> DataFrame:
    """(key, __first, __n): of the patterns that a text contains (and for which the test holds, on the columns of patterns and text) the first by `order` as a struct, and their number; no row without one."""
    met = contained(texts, key, text, patterns, pattern, **more)
    if test is not None:
        met = met.join(texts.select(key, text), key).filter(test)
    rest = [c for c in patterns.columns if c not in order]
    return met.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("__first"), F.count("*").alias("__n"))
