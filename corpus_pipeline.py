"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import langid
from halyard.llm.jaccard_join import one_of_each
from halyard.llm.line_dedup import dedup_lines
from halyard.llm.packing import default_tokenizer, pack_documents
from halyard.llm.scratch import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter go. Where languages tie, the one that sorts first counts."""
    docs = docs.select(*COLUMNS)
    found = langid.predict(docs, langid.fit(docs), keep=COLUMNS[1:])
    return found.filter(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; a document of which nothing is left goes."""
    out = dedup_lines(docs.select(*COLUMNS)).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest identifier."""
    return one_of_each(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences, with their token ids."""
    return pack_documents(docs.select("doc_id", "text"), default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("packing", packing),
]

# Language ID and the tokeniser are beyond SQL; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
