"""What a document says, whatever the day: parsed once, kept by key and version of the parser.

Verdicts depend on the day and are never kept; they are worked out from parses anew in each run.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.dates import advertised_window, date_range, signs_of_freshness
from halyard.functions.items import archive_blocks, by_date, dedupe_in_order, feed_items, index_blocks, with_urls
from halyard.functions.rules import classify_authority, classify_status, county_exceptions, current_status, toggle_status
from halyard.functions.text import content_hash, first_sentences, order_scope, status_fingerprint, strip_html, until_noon

VERSION = 1  # to be raised with every change of what a parse holds
ARTICLE_CHARS = 8_000
HINT = "flag"  # where a current-status page is looked at for changes
FEED, ARCHIVE, INDEX, TOGGLE, DIFF, ARTICLE, PROCLAMATION = "feed", "archive", "index", "toggle", "diff", "article", "proclamation"
SPAN = "struct<start_date:date,end_date:date>"
ITEMS = f"array<struct<ordinal:int,title:string,url:string,date:date,status:string,status_evidence:string,authority:string,scope:string,scope_evidence:string,span:{SPAN},until_noon:boolean>>"
# what a parse holds; what a kind of document does not tell is null
PARSE = {
    "hash": "string", "n_items": "int", "items": ITEMS, "status": "string", "evidence": "string", "authority": "string", "authority_evidence": "string", "span": SPAN,
    "modified": "date", "yearless": "array<struct<month:string,day:string>>", "counties": "array<struct<county:string,status:string>>",
}


def list_kind(mode: Column) -> Column:
    """How a page of this ingest mode is parsed: as an index unless it is known better."""
    return F.when(mode.isin(FEED, ARCHIVE, TOGGLE, DIFF), mode).otherwise(INDEX)


def parse_key(kind: Column, url: Column, dedupe: Column, html: Column) -> Column:
    """Changes with anything that a parse depends on but the parser: items' URLs are absolute, so the page's own counts too."""
    return F.sha2(F.concat_ws("\0", kind, F.coalesce(url, F.lit("")), F.coalesce(dedupe, F.lit(False)).cast("string"), F.coalesce(html, F.lit(""))), 256)


def _classified(items: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        status, scope = classify_status(x["title"]), order_scope(x["title"])
        return F.struct(
            i.alias("ordinal"), x["title"].alias("title"), x["url"].alias("url"), x["date"].alias("date"), status["value"].alias("status"), status["evidence"].alias("status_evidence"),
            classify_authority(x["title"])["value"].alias("authority"), scope["scope"].alias("scope"), scope["evidence"].alias("scope_evidence"), date_range(x["title"]).alias("span"), until_noon(x["title"]).alias("until_noon"),
        )

    return F.transform(items, one)


@cache
def _steps(application: str) -> tuple[dict[str, Column], ...]:
    """The columns to add, step by step, and those of PARSE. Building them takes seconds, so an application does it once."""
    kind = F.col("kind")
    part = lambda *kinds: F.when(kind.isin(*kinds), F.col("html"))  # noqa: E731 - null, so next to nothing to do, for other kinds
    of = lambda value, *kinds: F.when(kind.isin(*kinds), value)
    feed = feed_items(part(FEED, PROCLAMATION), F.col("url"))
    first = {
        "__blocks": F.when(kind == ARCHIVE, archive_blocks(part(ARCHIVE))).when(kind.isin(INDEX, PROCLAMATION), index_blocks(part(INDEX, PROCLAMATION))),
        "__feed": F.when(F.col("dedupe"), dedupe_in_order(feed)).otherwise(feed),
        "__toggle": of(toggle_status(part(TOGGLE)), TOGGLE),
        "__page": of(current_status(part(DIFF)), DIFF),
        "__by": of(classify_authority(part(DIFF)), DIFF),
        "__window": of(advertised_window(part(DIFF)), DIFF),
        "__fresh": of(signs_of_freshness(part(DIFF)), DIFF),
        "__body": of(strip_html(part(ARTICLE)), ARTICLE),
    }
    flags = F.transform(F.filter("__feed", lambda x: x["is_flag"]), lambda x: F.struct(*[x[c].alias(c) for c in ("ordinal", "title", "url", "date")]))
    listed = dedupe_in_order(F.col("__blocks"))
    items = F.when(kind == FEED, flags).when(kind == ARCHIVE, by_date(listed)).when(kind == INDEX, listed).when(kind == PROCLAMATION, F.when(F.size(listed) > 0, listed).otherwise(flags))
    second = {"items": _classified(items), "__opening": first_sentences(F.col("__body"))}
    third = {"__read": of(classify_status(F.col("__opening")), ARTICLE), "__read_by": of(classify_authority(F.col("__opening")), ARTICLE), "__late": of(date_range(F.left("__body", F.lit(ARTICLE_CHARS))), ARTICLE)}
    found = {
        "hash": F.when(kind == DIFF, status_fingerprint(part(DIFF), HINT)).otherwise(content_hash(F.col("html"))),
        "n_items": F.when(kind == FEED, F.size("__feed")).otherwise(F.size("items")),
        "items": F.col("items"),
        "status": F.coalesce("__toggle.value", "__page.value", "__read.value"),
        "evidence": F.coalesce("__toggle.evidence", "__page.evidence", "__read.evidence"),
        "authority": F.coalesce("__by.value", "__read_by.value"),
        "authority_evidence": F.coalesce("__by.evidence", "__read_by.evidence"),
        "span": F.coalesce("__window", "__late"),
        "modified": F.col("__fresh.modified"),
        "yearless": F.col("__fresh.yearless"),
        "counties": of(county_exceptions(part(DIFF)), DIFF),
    }
    return first, second, third, {c: found[c].cast(t).alias(c) for c, t in PARSE.items()}


def parsed(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep and of PARSE for each document (kind, url, dedupe, html), in one pass and without a shuffle.

    hash changes with what a document says: for current-status pages near HINT and without clock times,
    else with the visible text. n_items counts all items, items holds those about flags, in their order.
    """
    first, second, third, found = _steps(documents.sparkSession.sparkContext.applicationId)
    rows = documents.select(*keep, "kind", *[c for c in ("url", "html") if c not in keep], F.coalesce("dedupe", F.lit(False)).alias("dedupe"))
    return with_urls(rows.withColumns(first), "__blocks", "url").withColumns(second).withColumns(third).select(*keep, *found.values())


def known_and_new(documents: DataFrame, cache: DataFrame | None, version: int = VERSION) -> tuple[DataFrame | None, DataFrame]:
    """For documents (key, kind, url, dedupe, html): the rows of the cache (key, version, columns of PARSE) that they need, and the documents that it lacks, one a key.

    Only documents that the cache lacks are parsed. It may hold a row for each document, so nothing of it is broadcast.
    """
    if cache is None:
        return None, documents.dropDuplicates(["key"])
    valid = cache.filter(F.col("version") == version)
    lacking = documents.join(valid.select("key").hint("merge"), "key", "left_anti").dropDuplicates(["key"])
    return valid.join(documents.select("key").hint("merge"), "key", "left_semi"), lacking
