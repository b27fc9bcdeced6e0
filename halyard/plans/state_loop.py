"""Runs that follow one another: each reads what the last one committed, and commits what the next one reads.

Kept from run to run: the state (status, order, hash and stamps of each key, also of keys that have left the
registry), parses by content, the federal layer and its stamp, the records, and the log of changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators import parse, resolve, state
from halyard.plans import status_run as run
from halyard.sources.versions import Store, Version

STATE = f"state_code string, status string, `order` {run.ORDER}, hash string, last_changed_at timestamp, last_checked timestamp"
LOG = "key string, at timestamp, value string, reason string"
TABLES = ("state", "parses", "federal", "records", "document")


@dataclass(frozen=True)
class Sources:
    """What a run reads: registry; documents (url, html, error) and articles (url, html) as fetched; orders and seen of the mail run; the calendar; the URL of proclamations, if any."""

    registry: DataFrame
    documents: DataFrame
    articles: DataFrame
    orders: DataFrame
    seen: DataFrame
    calendar: DataFrame
    federal_url: str | None = None


def parses_of(documents: DataFrame, cache: DataFrame | None, keep, name: str, bodies: DataFrame | None = None) -> DataFrame:
    """Parses (key, version, columns of PARSE) of documents (key, kind, url, dedupe, html): those of the cache, and what it lacks, parsed now and kept.

    Documents without html come with bodies (url, html), in which it is looked up for what the cache lacks only.
    """
    known, lacking = parse.known_and_new(documents, cache)
    if bodies is not None:
        found = lacking.join(bodies.select("url", "html").hint("merge"), "url")
        lacking = found.filter(F.col("key") == parse.parse_key(F.col("kind"), F.col("url"), F.col("dedupe"), F.col("html")))
    fresh = keep(parse.parsed(lacking, "key").withColumn("version", F.lit(parse.VERSION)), name)
    return fresh if known is None else known.select(fresh.columns).unionByName(fresh)


def advance(store: Store, sources: Sources, batch: str, as_of: date, at: datetime, least_covered: int = 20, only: str | None = None) -> Version:
    """One run: read the last version, resolve all keys for a day, commit the next version.

    A batch that is committed already is returned as it is: nothing is written twice. A run that covers
    too few keys raises before it commits, and one that is restricted to a key (only) is refused: either
    would publish a gap. No page whose content is known is parsed again; verdicts are worked out anew.
    """
    last = store.latest()
    if last and last.batch == batch:
        return last
    if only is not None:
        raise ValueError("a run that is restricted to some keys is not published; use status_run.whole_run for it")
    spark, draft = store.spark, store.begin(batch)
    prior = last.table("state") if last else spark.createDataFrame([], STATE)
    cache = last.table("parses") if last else None
    day, now = F.lit(as_of), F.lit(at)

    pages = draft.keep(run.pages_of(sources.registry, sources.documents).drop("html"), "pages")
    page_parses = parses_of(run.to_parse(pages), cache, draft.keep, "fresh_pages", sources.documents)
    items = draft.keep(run.listed_items(pages, page_parses), "items")
    wanted = run.wanted_articles(items, sources.articles)
    article_parses = parses_of(wanted, cache, draft.keep, "fresh_articles")
    read = draft.keep(wanted.select("url", "key").join(article_parses.hint("merge"), "key"), "read")
    proclaimed = run.federal_page(sources.documents, sources.federal_url)
    known = [page_parses, article_parses]
    if proclaimed is not None:
        known.append(parses_of(proclaimed, cache, draft.keep, "fresh_federal"))
    parses = known[0]
    for more in known[1:]:
        parses = parses.unionByName(more)
    draft.keep(parses, "parses")

    fed = run.federal(sources.calendar, proclaimed and proclaimed.select("key").join(known[-1], "key"), day)
    told = F.sha2(F.coalesce(F.to_json(F.struct("status", "reason", "scope")), F.lit("")), 256)
    one = spark.range(1).join(fed, F.lit(True), "left").withColumn("hash", told).drop("id")
    before = last.table("federal").select(F.col("hash").alias("hash_before"), F.col("last_changed_at").alias("stamp_before")) if last else spark.createDataFrame([], "hash_before string, stamp_before timestamp")
    turned = F.coalesce(F.col("hash") != F.col("hash_before"), F.lit(False))
    one = one.join(before, F.lit(True), "left").withColumns({"changed": turned, "last_changed_at": F.when(turned | F.col("hash_before").isNull(), now).otherwise(F.col("stamp_before"))}).drop("hash_before", "stamp_before")
    one = draft.keep(one, "federal")
    fed = one.filter("status IS NOT NULL").drop("hash", "changed", "last_changed_at")

    states = run.evaluate(sources.registry, pages, page_parses, run.candidates(items, read), sources.orders, sources.seen, prior, day)
    records = draft.keep(run.finish(states, fed, prior, now), "records")
    turn = one.filter("changed").select(now.alias("at"), F.coalesce("status", F.lit("full")).alias("status"), "reason")
    of_run = run.Run.of(records, fed, turn)
    new = records.filter("coverage <> 'not_covered' OR hash IS NOT NULL").select("state_code", "status", "order", "hash", "last_changed_at", F.col("checked_at").alias("last_checked"))
    draft.keep(state.upsert(prior, new, "state_code", new.columns[1:]), "state")
    draft.keep(of_run.document(as_of.isoformat(), at.isoformat(), least_covered), "document")  # raises if too few are covered
    draft.log(of_run.changes)
    return draft.commit(*TABLES, *(n for n in draft.tables if n.startswith("fresh_")))


def parsed_count(version: Version) -> int:
    """How many documents the run of this version had to parse."""
    return sum(version.table(n).count() for n in version.tables if n.startswith("fresh_"))
