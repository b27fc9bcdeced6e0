"""Documents to items: arrays of struct(ordinal, title, url, date, ...), in document order; explode them when needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.dates import parse_any_date
from halyard.functions.text import FLAG, absolute_urls, is_relevant, is_translation, or_else, strip_html

# Patterns of feed items and of page blocks, and the limits on items and titles.
ITEM = r"(?isU)<(?:item|entry)\b.*?</(?:item|entry)>"
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"
LINK_TAG = r"""(?is)<link[^>]*?(?:href=["'](.*?)["']|>(.*?)</link>)"""
DATE_TAG = r"(?is)<(?:pubDate|published|updated|dc:date)[^>]*>(.*?)</"
BLOCK = r"(?isU)<(li|article|tr|h[1-4]|a)\b[^>]*>(.*?)</\1>"
HEADLINE = r"(?isU)<(a|h[1-4])\b[^>]*>(.*?)</\1>"
HREF = r"""(?i)href=["'](.*?)["']"""
MOST_ITEMS = 80
TITLE_CHARS = 200


def _blocks(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), 0)


def feed_items(xml: Column, base_url: Column, relevant: str = FLAG) -> Column:
    """Items of an RSS or Atom feed, well-formed or not: the first MOST_ITEMS, without those that lack a title; is_flag marks the relevant ones."""

    def one(item: Column, i: Column) -> Column:
        title = strip_html(F.regexp_extract(item, TITLE_TAG, 1))
        link = strip_html(or_else(F.regexp_extract(item, LINK_TAG, 1), F.regexp_extract(item, LINK_TAG, 2)))
        return F.struct(i.alias("ordinal"), title.alias("title"), or_else(link, base_url).alias("url"), parse_any_date(strip_html(F.regexp_extract(item, DATE_TAG, 1))).alias("date"), is_relevant(title, relevant).alias("is_flag"))

    return F.filter(F.transform(F.slice(_blocks(xml, ITEM), 1, MOST_ITEMS), one), lambda x: x["title"] != "")


def _href_items(blocks: Column, keep, relevant: str, with_date: bool) -> Column:
    def one(block: Column, i: Column) -> Column:
        text = strip_html(block)
        date = parse_any_date(text) if with_date else F.lit(None).cast("date")
        return F.struct(i.alias("ordinal"), F.left(text, F.lit(TITLE_CHARS)).alias("title"), F.regexp_extract(block, HREF, 1).alias("href"), date.alias("date"), (keep(block, text) & is_relevant(text, relevant)).alias("kept"))

    kept = F.filter(F.transform(blocks, one), lambda x: x["kept"])
    return F.transform(kept, lambda x: F.struct(x["ordinal"].alias("ordinal"), x["title"].alias("title"), x["href"].alias("href"), x["date"].alias("date")))


def archive_blocks(html: Column, relevant: str = FLAG) -> Column:
    """Dated candidates of an archive page. A block that holds several list items or articles is none itself."""

    def leaf(block: Column, text: Column) -> Column:
        several = [(F.char_length(block) - F.char_length(F.replace(block, F.lit(tag), F.lit("")))) > len(tag) for tag in ("<li", "<article")]
        return (F.char_length(text) >= 10) & ~several[0] & ~several[1]

    return _href_items(_blocks(html, BLOCK), leaf, relevant, True)


def index_blocks(html: Column, relevant: str = FLAG) -> Column:
    """Headlines of an index page, of 12 to 300 characters."""
    return _href_items(_blocks(html, HEADLINE), lambda _, text: F.char_length(text).between(12, 300), relevant, True)


def dedupe_in_order(items: Column) -> Column:
    """The items that stay when each is dropped whose url or lower-cased title a kept one has already, or that is a translation. Empty ones never clash."""
    keyed = F.filter(items, lambda x: ~is_translation(x["title"]))

    def fold(kept: Column, x: Column) -> Column:
        def clash(y: Column) -> Column:
            same_url = (F.coalesce(x["url"], F.lit("")) != "") & (x["url"] == y["url"])
            same_title = (F.coalesce(x["title"], F.lit("")) != "") & (F.lower(x["title"]) == F.lower(y["title"]))
            return F.coalesce(same_url, F.lit(False)) | F.coalesce(same_title, F.lit(False))

        return F.when(F.exists(kept, clash), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(keyed, F.slice(keyed, 1, 0), fold)


def exploded(docs: DataFrame, items: Column, *keys: str) -> DataFrame:
    """One row per item, beside the keys of its document."""
    return docs.select(*keys, F.explode(items).alias("item")).select(*keys, "item.*")


def with_urls(docs: DataFrame, blocks: str, base: str) -> DataFrame:
    """docs with the column of blocks as items with absolute URLs: array of struct(ordinal, title, url, date). Nothing is shuffled."""
    rows = docs.withColumn("__urls", absolute_urls(F.transform(blocks, lambda x: x["href"]), F.col(base)))
    with_url = F.zip_with(blocks, "__urls", lambda x, url: F.struct(x["ordinal"].alias("ordinal"), x["title"].alias("title"), url.alias("url"), x["date"].alias("date")))
    return rows.withColumn(blocks, with_url).drop("__urls")


def _resolved(docs: DataFrame, blocks: Column, keys: tuple[str, ...], base: str) -> DataFrame:
    rows = docs.select(*keys, F.col(base).alias("__base"), blocks.alias("items"))
    return with_urls(rows, "items", "__base").drop("__base")


def by_date(items: Column) -> Column:
    """items in the order of an archive: latest date first, undated last, then as they were."""
    order = lambda x: F.struct(x["date"].isNull().alias("undated"), (-F.unix_date(x["date"])).alias("d"), x["ordinal"].alias("ordinal"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(items, order)), lambda o: o["x"])


def archive_items(docs: DataFrame, keys: tuple[str, ...], html: str = "html", base: str = "url", relevant: str = FLAG) -> DataFrame:
    """Items of archive pages, one row each, deduplicated within their page, with their rank: latest date first, undated last, then page order."""
    rows = _resolved(docs, archive_blocks(F.col(html), relevant), keys, base)
    ranked = rows.select(*keys, F.posexplode(by_date(dedupe_in_order(F.col("items")))).alias("rank", "x"))
    return ranked.select(*keys, "rank", "x.title", "x.url", "x.date")


def index_items(docs: DataFrame, keys: tuple[str, ...], html: str = "html", base: str = "url", relevant: str = FLAG) -> DataFrame:
    """Items of index pages in page order, deduplicated within their page."""
    return exploded(_resolved(docs, index_blocks(F.col(html), relevant), keys, base), dedupe_in_order(F.col("items")), *keys)
