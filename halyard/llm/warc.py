"""WARC not-modified revisits: an as-of join to the latest earlier full response of the same URL.

Records are ordered by date within (canonical URL, minute); a minute's last response is carried on
within its day over one row per URL and minute, and a day's last one over one row per URL and day. So a
URL that holds a third of all records is spread over its minutes, however many days there are, and no
task sees it whole. Only identifiers, validators and headers are shuffled, not bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a 304 response may update, and query parameters that only track visits.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without trailing slash, sorted query without tracking; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    args = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda a: (a != "") & ~a.rlike(TRACKING))
    query = F.array_join(F.array_sort(args), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit record: record_id, url_key, date, refers_to, outcome, headers.

    records: record_id, url, date (timestamp), kind (response or revisit), etag, last_modified (string)
    and headers (map of strings, any case). A revisit refers to the response of its canonical URL with
    the greatest earlier date (ties: greatest record_id). Its outcome is `resolved` if the validators
    it carries agree with that response's (ETags compared weakly; where it has no ETag, Last-Modified;
    where it has neither, `resolved` too), `validator_mismatch` if not, `no_earlier_response` without
    one. refers_to is null unless resolved. headers are the response's, updated by those of the revisit
    that a 304 may change; unresolved, the revisit's own. Null URLs or dates never resolve, and are not
    shuffled; other kinds and further columns are ignored; rows that repeat come out repeated.
    """
    lower = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "date", "kind", F.to_date("date").alias("day"), F.date_trunc("minute", "date").alias("minute"), "etag", "last_modified", lower.alias("headers")
    )
    usable = F.col("url_key").isNotNull() & F.col("date").isNotNull()
    never = rows.filter(~usable & (F.col("kind") == "revisit"))
    full = F.when(F.col("kind") == "response", F.struct("date", "record_id", "etag", "last_modified", "headers"))
    rows = rows.filter(usable).withColumn("full", full)
    before = (Window.unboundedPreceding, -1)
    # at one date the revisits come first: a response must be earlier
    within = Window.partitionBy("url_key", "minute").orderBy("date", F.col("kind") == "response", "record_id").rowsBetween(*before)
    order = F.when(F.col("full").isNotNull(), F.struct("date", "record_id"))
    minutes = rows.groupBy("url_key", "day", "minute").agg(F.max_by("full", order).alias("last"), F.bool_or(F.col("kind") == "revisit").alias("asked"))
    days = minutes.groupBy("url_key", "day").agg(F.max_by("last", F.when(F.col("last").isNotNull(), F.col("minute"))).alias("last"), F.bool_or("asked").alias("asked"))

    def carried(slices: DataFrame, key: list[str], at: str) -> DataFrame:
        """The slices that hold revisits, each with the last response of the slices before it."""
        earlier = F.last("last", ignorenulls=True).over(Window.partitionBy(*key).orderBy(at).rowsBetween(*before))
        return slices.withColumn(f"by_{at}", earlier).filter("asked").select(*key, at, f"by_{at}")

    earlier = carried(minutes, ["url_key", "day"], "minute").join(carried(days, ["url_key"], "day"), ["url_key", "day"])
    earlier = earlier.select("url_key", "minute", F.coalesce("by_minute", "by_day").alias("carried"))
    found = rows.withColumn("now", F.last("full", ignorenulls=True).over(within)).filter("kind = 'revisit'")
    found = found.join(earlier, ["url_key", "minute"]).withColumn("r", F.coalesce("now", "carried")).drop("day", "minute", "full", "now", "carried")
    found = found.unionByName(never.drop("day", "minute"), allowMissingColumns=True)
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    agrees = (
        F.when(F.col("etag").isNotNull(), F.coalesce(weak(F.col("etag")) == weak(F.col("r.etag")), F.lit(False)))
        .when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("r.last_modified"), F.lit(False)))
        .otherwise(True)
    )
    outcome = F.when(F.col("r").isNull(), "no_earlier_response").when(agrees, "resolved").otherwise("validator_mismatch")
    found = found.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("r.headers", lambda k, _: ~F.array_contains(F.map_keys(update), k))
    return found.select(
        "record_id", "url_key", "date", F.when(good, F.col("r.record_id")).alias("refers_to"), "outcome", F.when(good, F.map_concat(kept, update)).otherwise(F.col("headers")).alias("headers")
    )


def with_payload(resolved: DataFrame, records: DataFrame, body_col: str) -> DataFrame:
    """resolved with the body of the response that each revisit refers to (null where unresolved)."""
    bodies = records.filter("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col(body_col).alias("body"))
    return resolved.join(bodies, "refers_to", "left")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl of the pages: page n is fetched in full n hours after 2024-01-01 and asked again later.

    The second request comes 30 days later; for every seventh page an hour before the first instead.
    Every fifth page has got another ETag by then, and the one after those is asked by Last-Modified.
    """
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    modified = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), at.alias("date"), F.lit("response").alias("kind"), tag.alias("etag"), modified.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), modified).alias("headers"),
    )
    later = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600 + F.when(F.col("page_id") % 7 == 0, -3600).otherwise(30 * 86400))
    asked = F.when(F.col("page_id") % 5 == 0, F.lit('W/"other"')).when(F.col("page_id") % 5 != 1, F.concat(F.lit("W/"), tag))
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), later.alias("date"), F.lit("revisit").alias("kind"), asked.alias("etag"), F.when(F.col("page_id") % 5 == 1, modified).alias("last_modified"),
        F.create_map(F.lit("Date"), F.date_format(later, "yyyy-MM-dd HH:mm:ss"), F.lit("Content-Type"), F.lit("text/plain"), F.lit("Cache-Control"), F.lit("no-cache")).alias("headers"),
    )
    return pages.select("url", F.explode(F.array(response, revisit)).alias("r")).select("url", "r.*")


def op5_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """The revisits of a crawl of all pages, resolved; a page without URL never resolves."""
    found = resolve_revisits(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select(F.expr("(record_id - 1) div 2").alias("page_id"), "url_key", F.expr("refers_to div 2").alias("refers_to_page"), "outcome", shown.alias("headers"))


ORACLE = """
WITH p AS (
  SELECT page_id, '"' || md5(coalesce(html, '')) || '"' AS tag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), u AS (
  SELECT page_id, tag, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\\.', ''), ':(?:80|443)$', '') AS host, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda a: a <> '' AND NOT regexp_matches(a, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)'))), '&') AS args FROM p
), k AS (
  SELECT page_id, tag, host || path || CASE WHEN args <> '' THEN '?' || args ELSE '' END AS url_key FROM u
), r AS (
  SELECT url_key, page_id, 0 AS revisit, page_id * 3600 AS at_s, tag AS etag, strftime(make_timestamp((1704067200 + page_id * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS modified FROM k
  UNION ALL
  SELECT url_key, page_id, 1, page_id * 3600 + CASE WHEN page_id % 7 = 0 THEN -3600 ELSE 30 * 86400 END,
    CASE WHEN page_id % 5 = 0 THEN '"other"' WHEN page_id % 5 <> 1 THEN tag END,
    CASE WHEN page_id % 5 = 1 THEN strftime(make_timestamp((1704067200 + page_id * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') END FROM k
), a AS (
  SELECT *, last_value(CASE WHEN revisit = 0 THEN {'page_id': page_id, 'etag': etag, 'modified': modified} END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY at_s, 1 - revisit, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM r
), o AS (
  SELECT *, CASE WHEN f IS NULL THEN 'no_earlier_response' WHEN etag IS NOT NULL THEN CASE WHEN etag = f.etag THEN 'resolved' ELSE 'validator_mismatch' END WHEN modified = f.modified THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
    strftime(make_timestamp((1704067200 + at_s) * 1000000), '%Y-%m-%d %H:%M:%S') AS seen FROM a WHERE revisit = 1
)
SELECT page_id, url_key, CASE WHEN outcome = 'resolved' THEN f.page_id END AS refers_to_page, outcome,
  'cache-control=no-cache;content-type=' || CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE 'text/plain' END || ';date=' || seen || CASE WHEN outcome = 'resolved' THEN ';etag=' || f.etag ELSE '' END AS headers
FROM o
"""
