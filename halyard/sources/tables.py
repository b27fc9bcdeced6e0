"""Sources and sinks: snapshots of JSON documents, fetched pages, access policies, overwrites and append-only logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StructType

BODY_CHARS = 400_000
REGISTRY = """state string, state_code string, ingest_mode string, confidence string, buildable boolean, rss_url string, flag_page_url string,
press_url string, toggle_hub_url string, url_candidates array<string>, signature_check_required boolean, dedupe_translations boolean,
notification_channel struct<type:string,detail:string,account:string>, expected_sender_domain string, blocked_reason string"""
OBSERVANCE = "id string, name string, date string, active boolean, scope string, authority string, citation string, reason string, note string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array of objects. A missing or malformed file has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    names = StructType.fromDDL(schema).fieldNames()
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).filter(F.coalesce(*[F.when(F.col(n).isNotNull(), 1) for n in names]).isNotNull())


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """key and columns of a JSON object of objects. Keys that begin with _ are about the document itself and are left out."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"key string, {value_schema}")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    entries = whole.select(F.explode(F.map_filter("m", lambda k, _: ~k.startswith("_"))).alias("key", "value"))
    return entries.select("key", F.from_json("value", value_schema).alias("v")).filter("v IS NOT NULL").select("key", "v.*")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Observances of all years with their ordinal in the file's order."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"years map<string,array<struct<{', '.join(':'.join(c.split()) for c in OBSERVANCE.split(', '))}>>>").alias("d"))
    rows = whole.select(F.explode("d.years").alias("year", "list")).select(F.posexplode("list").alias("ordinal", "o")).select("ordinal", "o.*")
    return rows.withColumn("date", F.try_to_date("date", "yyyy-MM-dd"))


@pandas_udf(BooleanType())
def _may_fetch(url: pd.Series, rules: pd.Series) -> pd.Series:
    from functools import cache
    from urllib.robotparser import RobotFileParser

    @cache
    def parsed(text: str) -> RobotFileParser:
        out = RobotFileParser()
        out.parse(text.splitlines())
        return out

    return pd.Series([not isinstance(r, str) or parsed(r).can_fetch("*", u) for u, r in zip(url, rules, strict=True)])


def access_policy(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """url, allowed. Only a rule of a robots.txt (site, status, content_type, body) that was read well, and is no HTML, forbids a URL."""
    from halyard.functions.text import site

    readable = (F.col("status") == 200) & ~F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html"))
    rules = robots.filter(readable).select(F.col("site").alias("__site"), F.col("body").alias("__rules"))
    rows = urls.select("url").withColumn("__site", site(F.col("url"))).join(rules, "__site", "left")
    return rows.select("url", F.coalesce(_may_fetch(F.col("url"), F.col("__rules")), F.lit(True)).alias("allowed"))


def documents(landed: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """url, html, error of landed fetches (url, status, body, error), cut to BODY_CHARS.

    policy, by site or by url (and allowed), blocks only where it says so; no row, or null, allows.
    """
    from halyard.functions.text import site

    rows = landed.withColumn("__site", site(F.col("url")))
    allowed = F.lit(True)
    if policy is not None:
        on = "url" if "url" in policy.columns else "__site"
        rows = rows.join(policy.select(F.col(on.strip("_")).alias(on), "allowed"), on, "left")
        allowed = F.coalesce("allowed", F.lit(True))
    error = (
        F.when(F.coalesce("url", F.lit("")) == "", "no url").when(~allowed, "blocked by robots.txt").when(F.col("error").isNotNull(), F.col("error")).when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    )
    return rows.select("url", F.when(error.isNull(), F.left("body", F.lit(BODY_CHARS))).alias("html"), error.alias("error"))


MOST_IN_DOCUMENT = 100_000
IN_PART = 20_000


def _by_code(states: DataFrame) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("state_code", F.struct(*[c for c in states.columns if c != "state_code"])))))


def _as_json(out: DataFrame, part: Column, counts: DataFrame, date: str, federal: DataFrame | None, generated_at: str | None) -> DataFrame:
    """Beside each row's states the document of them, with its part of all codes (null: it is the whole), the federal layer and the counts."""
    out = out.join(F.broadcast(counts.select(F.struct(*counts.columns).alias("meta"))), how="left")
    fed = F.lit(None)
    if federal is not None:
        out, fed = out.join(F.broadcast(federal.select(F.struct(*federal.columns).alias("federal"))), F.lit(True), "left"), F.col("federal")
    return out.withColumn("document", F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), F.lit(date).alias("date"), part.alias("part"), fed.alias("federal"), "states", "meta")))


def status_document(states: DataFrame, counts: DataFrame, date: str, federal: DataFrame | None = None, generated_at: str | None = None) -> DataFrame:
    """One JSON document: generated_at, date, federal (if any), all states by code, and the counts.

    For no more than MOST_IN_DOCUMENT states, which is checked before they are collected; document_parts() takes any number.
    """
    from halyard.operators.resolve import at_most

    return _as_json(at_most(states, MOST_IN_DOCUMENT).agg(_by_code(states).alias("states")), F.lit(None), counts, date, federal, generated_at).select("document")


def document_parts(states: DataFrame, n: int, counts: DataFrame, date: str, federal: DataFrame | None = None, generated_at: str | None = None) -> DataFrame:
    """first_code, last_code, n_states, document: the document of n states, by ranges of their codes, of no more than IN_PART states each.

    Each part is a document like that of status_document(), which tells its first and last code in `part`; the counts
    are of all parts. Up to IN_PART states are one document, the whole.
    """
    ends = F.min("state_code").alias("first_code"), F.max("state_code").alias("last_code"), F.count("*").alias("n_states"), _by_code(states).alias("states")
    if n <= IN_PART:
        out, part = states.agg(*ends), F.lit(None)
    else:
        ranges = 2 * -(-n // IN_PART)  # half full, as their bounds come of a sample; one that is too long is cut by rank
        dealt = states.repartitionByRange(ranges, "state_code").withColumn("__range", F.spark_partition_id()).repartition(ranges, "__range")
        rank = F.row_number().over(Window.partitionBy("__range").orderBy("state_code"))
        out = dealt.withColumn("__cut", F.floor((rank - 1) / IN_PART)).groupBy("__range", "__cut").agg(*ends)
        part = F.struct(F.col("first_code").alias("first"), F.col("last_code").alias("last"))
    return _as_json(out, part, counts, date, federal, generated_at).select("first_code", "last_code", "n_states", "document")


def notices(changed: DataFrame) -> DataFrame:
    """Payloads to send for changed rows (key, value); one tag per key, so that a later notice replaces an earlier one."""
    title = F.when(F.col("value") == "half", "to half-staff").otherwise("back to full staff")
    return changed.select("key", F.to_json(F.struct(F.concat(F.lit("flag-"), F.coalesce("key", F.lit("us"))).alias("tag"), title.alias("title"), F.coalesce("value", F.lit("unknown")).alias("status"))).alias("payload"))
