"""A whole status run: registry and fetched documents to one effective status per key.

Every row of the registry comes out exactly once, whatever fails on the way. Documents are parsed once
(operators.parse); a day's verdicts follow from what was parsed, in one pass over the rows of the registry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.dates import modified_on
from halyard.functions.rules import FULL, GOVERNOR, HALF, UNKNOWN
from halyard.functions.text import order_hash
from halyard.operators import parse, resolve
from halyard.operators.coverage import covers
from halyard.operators.state import changed_feed
from halyard.sources.scratch import written
from halyard.sources.tables import document_parts, notices

KEY = "state_code"
ORDER = "struct<title:string,url:string,status:string,authority:string,evidence:string,start_date:date,end_date:date,until_noon:boolean,why:string,via:string>"
FIELDS = tuple(f.split(":")[0] for f in ORDER[7:-1].split(","))
FEDERAL = "struct<status:string,scope:string,reason:string,detail:string,authority:string,citation:string,source_url:string,end_date:date>"
VIA_MAIL = "official notification email"
FEDERAL_URL = "halyard.federal.url"  # the setting of a session that names the page of proclamations, if any


def order_of(**fields: Column) -> Column:
    """An order of these fields; the others are null."""
    return F.struct(*[fields.get(f, F.lit(None)).alias(f) for f in FIELDS]).cast(ORDER)


def _known(order: str, have: tuple[str, ...]) -> dict[str, Column]:
    return {f: F.col(f"{order}.{f}") for f in FIELDS if f in have}


def pages_of(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """Registry rows that are fetched, with used_url, html, error, and kind and key of the parse they need."""
    web = registry.filter(~F.col("ingest_mode").eqNullSafe("email") & F.coalesce("buildable", F.lit(False)))
    row = F.struct("ingest_mode", "toggle_hub_url", "press_url", "rss_url", "flag_page_url")
    asked = web.select(KEY, "ingest_mode", "url_candidates", "dedupe_translations", "signature_check_required", resolve.pick_url(row).alias("url"))
    rows = resolve.with_alternates(asked, documents, KEY).withColumn("kind", parse.list_kind(F.coalesce("ingest_mode", F.lit(""))))
    dedupe = F.coalesce("dedupe_translations", F.lit(False)) & ~F.col("kind").isin(parse.TOGGLE, parse.DIFF)
    rows = rows.withColumn("dedupe", dedupe).withColumn("key", F.when(F.col("error").isNull(), parse.parse_key(F.col("kind"), F.col("used_url"), F.col("dedupe"), F.col("html"))))
    return rows.select(KEY, "url", "used_url", "error", "kind", "dedupe", "signature_check_required", "key", "html")


def to_parse(pages: DataFrame) -> DataFrame:
    """Documents (key, kind, url, dedupe, html) of the pages that were read; without html where pages have none."""
    return pages.filter("key IS NOT NULL").select("key", "kind", F.col("used_url").alias("url"), "dedupe", *[c for c in pages.columns if c == "html"])


def listed_items(pages: DataFrame, parses: DataFrame) -> DataFrame:
    """One row per item about flags of the list pages, beside its page; a page without any, but with other items, is one row without an item."""
    lists = pages.filter(F.col("key").isNotNull() & ~F.col("kind").isin(parse.TOGGLE, parse.DIFF)).join(parses.select("key", "items", "n_items").hint("merge"), "key")
    rows = lists.filter("n_items > 0").select(KEY, F.col("used_url").alias("page_url"), F.coalesce("signature_check_required", F.lit(False)).alias("signed"), F.explode_outer("items").alias("x"))
    return rows.select(KEY, "page_url", "signed", "x.*")


def wanted_articles(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Documents (key, kind, url, dedupe, html) of the articles (url, html) that some item needs.

    An article is looked up only where the headline tells no status or gives no end.
    """
    urls = items.filter(_wanted()).select("url").distinct()
    found = articles.filter("html IS NOT NULL").join(urls.hint("merge"), "url", "left_semi").select(F.lit(parse.ARTICLE).alias("kind"), "url", F.lit(False).alias("dedupe"), "html")
    return found.withColumn("key", parse.parse_key(F.col("kind"), F.lit(None), F.col("dedupe"), F.col("html")))


def _wanted() -> Column:
    told, ends = F.col("status") != UNKNOWN, F.col("span.end_date").isNotNull()
    return (F.col("url") != F.col("page_url")) & ~(told & ends)


def candidates(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Items as candidates for fold_candidates: each source is used for what it is reliable at.

    articles: url and the parse of each. The headline tells status, authority and scope; the article's
    opening status and authority where the headline tells no status; its text dates where the headline gives no end.
    """
    told, ends = F.col("status") != UNKNOWN, F.col("span.end_date").isNotNull()
    read = articles.select("url", F.struct("status", "evidence", "authority", "span").alias("article"))
    rows = resolve.enrich(items, read, _wanted(), "url", ["article"])
    opened = ~told & (F.coalesce("article.status", F.lit(UNKNOWN)) != UNKNOWN)
    late = lambda c: F.when(~F.coalesce(ends, F.lit(False)), F.col(f"article.span.{c}"))
    return rows.select(
        KEY, "signed", "ordinal", "title", "url", "date",
        F.when(opened, F.col("article.status")).otherwise(F.col("status")).alias("status"),
        F.when(opened, F.concat(F.lit("from order body: "), F.col("article.evidence"))).otherwise(F.col("status_evidence")).alias("evidence"),
        F.when(opened & (F.col("article.authority") != UNKNOWN), F.col("article.authority")).otherwise(F.col("authority")).alias("authority"),
        "scope", "scope_evidence", F.coalesce("span.start_date", late("start_date")).alias("start_date"), F.coalesce("span.end_date", late("end_date")).alias("end_date"), "until_noon",
    )


def evaluate(registry: DataFrame, pages: DataFrame, parses: DataFrame, items: DataFrame, orders: DataFrame, seen: DataFrame, prior: DataFrame, as_of: Column) -> DataFrame:
    """One row per registry row: its record for the day, from what was parsed of its page.

    items are candidates(). prior: state_code, status, order. A source that cannot be read keeps its last
    status and order, and is stale. hash changes with what a source says; null where it says nothing.
    All tables may have a row for each key, so none is broadcast.
    """
    shown = ("url", "until_noon", "evidence")
    folded = resolve.fold_candidates(items, KEY, as_of, F.col("signed"), shown).select(
        KEY, F.col("status").alias("found"), F.when(F.col("order").isNotNull(), order_of(**_known("order", FIELDS[:2] + FIELDS[3:9]), status=F.lit(HALF))).alias("listed"),
        F.when(F.col("last_expired_order").isNotNull(), order_of(**_known("last_expired_order", FIELDS[:2] + FIELDS[3:9]), status=F.lit(HALF))).alias("expired"), "limited_orders",
    )
    of_parse = ["hash", "status", "evidence", "authority", "authority_evidence", "span", "modified", "yearless", "counties"]
    facts = parses.select(F.col("key").alias("__parse"), F.struct(*of_parse).alias("p")).hint("merge")
    mail = orders.select(KEY, F.struct(*[c for c in ("title", "authority", "start_date", "end_date", "until_noon") if c in orders.columns]).alias("mail"))
    rows = (
        registry.join(pages.select(KEY, "url", "used_url", F.col("error").alias("fetch_error"), "key").hint("merge"), KEY, "left").withColumn("__parse", resolve.known_or_own(F.col("key"), F.col(KEY))).join(facts, "__parse", "left")
        .join(folded.hint("merge"), KEY, "left").join(mail.hint("merge"), KEY, "left").join(seen.select(KEY, "seen_on").hint("merge"), KEY, "left")
        .join(prior.select(KEY, F.col("status").alias("before"), F.col("order").alias("order_before")).hint("merge"), KEY, "left")
    )
    mode = F.coalesce("ingest_mode", F.lit(""))
    by_mail, unbuilt, failed = mode == "email", ~F.coalesce("buildable", F.lit(False)), F.col("fetch_error").isNotNull()
    toggle, diff = mode == parse.TOGGLE, mode == parse.DIFF
    signed = F.coalesce("signature_check_required", F.lit(False))
    modified = modified_on(F.col("p"), as_of)
    rows = rows.withColumn("mail_covers", covers(F.col("mail.start_date"), F.col("mail.end_date"), as_of)).withColumn("modified", F.when(diff, modified))
    rows = rows.withColumn("v", F.when(diff & ~failed & ~unbuilt, resolve.verdict_of_page(F.col("p.status"), F.col("p.span"), F.col("modified"), F.col("p.authority"), signed, as_of)))
    has, heard = F.col("mail").isNotNull(), F.col("seen_on").isNotNull()
    mailed = F.coalesce("mail_covers.verdict", F.lit(False))
    ladder = lambda mail, none, fail, tog, page, rest: F.when(by_mail, mail).when(unbuilt, none).when(failed, fail).when(toggle, tog).when(diff, page).otherwise(rest)
    null = F.lit(None)
    status = ladder(F.when(has & mailed, HALF).when(has | heard, FULL).otherwise(UNKNOWN), F.lit(UNKNOWN), F.coalesce("before", F.lit(UNKNOWN)), F.col("p.status"), F.col("v.status"), F.coalesce("found", F.lit(UNKNOWN)))
    coverage = ladder(F.when(has | heard, "covered").otherwise("not_covered"), F.lit("not_covered"), F.when(F.col("before").isNotNull(), "stale").otherwise("not_covered"), F.lit("covered"), F.col("v.coverage"), F.lit("covered"))
    error = ladder(
        F.when(~has & ~heard, resolve.NEVER_HEARD), F.lit(resolve.NO_SOURCE), F.col("fetch_error"), F.when(F.col("p.status") == UNKNOWN, F.col("p.evidence")), F.col("v.error"), F.when(F.col("found").isNull(), resolve.NO_ITEMS),
    )
    detail = F.col("notification_channel.detail") if "notification_channel" in registry.columns else null.cast("string")
    told = _known("mail", tuple(c for c in ("title", "authority", "start_date", "end_date", "until_noon") if c in orders.columns))
    half_by_mail = F.when(has & mailed, order_of(**told, url=detail, status=F.lit(HALF), why=F.col("mail_covers.why"), via=F.lit(VIA_MAIL)))
    toggled = F.when(F.col("p.status") != UNKNOWN, order_of(url=F.col("used_url"), status=F.col("p.status"), authority=F.lit(GOVERNOR), evidence=F.col("p.evidence")))
    proven = signed & (F.col("v.status") == HALF)
    by = F.when(proven | ~signed, GOVERNOR).otherwise(UNKNOWN)
    paged = F.when(F.col("v.status") != UNKNOWN, order_of(url=F.col("used_url"), status=F.col("v.status"), authority=by, evidence=F.when(proven, F.col("p.authority_evidence")).otherwise(F.col("p.evidence"))))
    order = ladder(half_by_mail, null, F.col("order_before"), toggled, paged, F.col("listed"))
    expired = ladder(null, null, null, null, F.when(F.col("v.ended"), order_of(url=F.col("used_url"), why=F.col("v.why"))), F.col("expired"))
    mail_hash = F.when(has, order_hash(order_of(**told), ORDER))
    on_page = diff & ~failed & ~unbuilt
    return rows.select(
        KEY, *[c for c in ("state", "confidence") if c in registry.columns], "ingest_mode", status.alias("status"), coverage.alias("coverage"), error.alias("error"), order.alias("order"), expired.alias("last_expired_order"),
        F.when(~by_mail & ~unbuilt & ~failed, F.col("limited_orders")).alias("limited_orders"), F.when(on_page & ~F.col("v.frozen") & (F.size("p.counties") > 0), F.col("p.counties")).alias("county_exceptions"),
        F.when(toggle | diff, F.col("p.evidence")).alias("evidence"), F.when(by_mail & ~has, F.col("seen_on")).alias("channel_last_heard"),
        F.when(by_mail, detail).when(unbuilt, null).otherwise(F.coalesce("used_url", "url")).alias("source_url"), F.when(~by_mail & ~unbuilt & (F.col("used_url") != F.col("url")), True).alias("used_alternate_url"),
        F.when(on_page, F.col("v.age_days")).alias("source_age_days"), F.when(on_page & F.col("v.freshness_unknown"), True).alias("freshness_unknown"), F.when(on_page, F.col("modified")).alias("source_last_modified"),
        F.when(by_mail, mail_hash).when(~unbuilt & ~failed, F.col("p.hash")).alias("hash"),
    )


def resolve_states(registry: DataFrame, documents: DataFrame, articles: DataFrame, orders: DataFrame, seen: DataFrame, prior: DataFrame, as_of: Column) -> DataFrame:
    """evaluate() over documents that are all parsed for it; prior may lack order.

    orders: state_code, title, start_date, end_date, until_noon; seen: state_code, seen_on. Parses are
    written to the session's shared folder, as each is read several times.
    """
    pages = pages_of(registry, documents)
    parses = written(parse.parsed(to_parse(pages).dropDuplicates(["key"]), "key"), "parses")
    pages = written(pages.drop("html"), "pages")
    items = written(listed_items(pages, parses), "items")
    read = written(parse.parsed(wanted_articles(items, articles), "url"), "articles")
    return evaluate(registry, pages, parses, candidates(items, read), orders, seen, with_order(prior), as_of)


def with_order(prior: DataFrame) -> DataFrame:
    """prior with its order as ORDER: by name, null where it has none."""
    if "order" not in prior.columns:
        return prior.withColumn("order", F.lit(None).cast(ORDER))
    have = prior.select("order.*").columns
    return prior.withColumn("order", F.when(F.col("order").isNotNull(), order_of(**{f: F.col(f"order.{f}") for f in FIELDS if f in have})))


@dataclass
class Run:
    """The tables of one run: records (one row per key), the federal layer (no row or one), counts, codes, changes for the log, and the notices to send."""

    records: DataFrame
    federal: DataFrame
    counts: DataFrame
    codes: DataFrame
    changes: DataFrame
    notices: DataFrame

    @classmethod
    def of(cls, records: DataFrame, federal: DataFrame, turned: DataFrame | None = None) -> Run:
        """From records, and whether the federal layer has turned (at, status, reason: no row or one)."""
        changes = changed_feed(records, KEY, "checked_at", "effective_status", "reason")
        if turned is not None:
            changes = changes.unionByName(turned.select(F.lit("US").alias("key"), "at", F.col("status").alias("value"), "reason"))
        return cls(records, federal, resolve.coverage_counts(records), resolve.half_and_changed(records, KEY), changes, notices(changes))

    def document(self, date: str, generated_at: str | None = None, least_covered: int = 20) -> DataFrame:
        """The published document, in parts where there are many keys; refused when it is read if too few keys are covered."""
        return document_parts(resolve.publishable(self.records, least_covered), self.records.count(), self.counts, date, self.federal, generated_at)


def finish(states: DataFrame, federal: DataFrame, prior: DataFrame, at: Column) -> DataFrame:
    """Records of evaluate() under the federal layer, with changed, last_changed_at and checked_at against prior (state_code, hash, last_changed_at).

    A key has changed when its source says something else than before; a first sighting is no change,
    but its time is kept. A source that says nothing keeps its hash.
    """
    states = states.withColumns({"order_title": F.col("order.title"), "until_noon": F.coalesce("order.until_noon", F.lit(False))})
    states = resolve.overlay(states, federal).drop("order_title", "until_noon")
    states = states.join(prior.select(KEY, F.col("hash").alias("__hash"), F.col("last_changed_at").alias("__changed_at")).hint("merge"), KEY, "left")
    changed = F.coalesce(F.col("hash") != F.col("__hash"), F.lit(False))
    moved = F.col("hash").isNotNull() & (changed | F.col("__hash").isNull())
    return states.withColumns({"changed": changed, "last_changed_at": F.when(moved, at).otherwise(F.col("__changed_at")), "hash": F.coalesce("hash", "__hash"), "checked_at": at}).drop("__hash", "__changed_at")


def whole_run(registry: DataFrame, documents: DataFrame, articles: DataFrame, orders: DataFrame, seen: DataFrame, prior: DataFrame, calendar: DataFrame, as_of: Column, at: Column, federal_url: str | None = None) -> Run:
    """From the registry (state_code, state, confidence, ...) to what is published, without memory of parses (see plans.state_loop). Records are written once.

    prior: state_code, status, order, hash, last_changed_at of the last run. federal_url names the
    document that lists proclamations; by default the session's setting FEDERAL_URL does, if it is set.
    """
    page = federal_page(documents, federal_url)
    proclaimed = None if page is None else parse.parsed(page, "url")
    fed = federal(calendar, proclaimed, as_of)
    states = resolve_states(registry, documents, articles, orders, seen, prior, as_of)
    return Run.of(written(finish(states, fed, prior, at), "records"), fed)


# --- the federal layer ----------------------------------------------------------------------------


def federal_page(documents: DataFrame, url: str | None = None) -> DataFrame | None:
    """The document of proclamations to parse (key, kind, url, dedupe, html): no row or one; None if no URL is set."""
    url = url or documents.sparkSession.conf.get(FEDERAL_URL, None)
    if not url:
        return None
    rows = documents.filter((F.col("url") == url) & F.col("error").isNull() & F.col("html").isNotNull()).select(F.lit(parse.PROCLAMATION).alias("kind"), "url", F.lit(False).alias("dedupe"), "html")
    return rows.withColumn("key", parse.parse_key(F.col("kind"), F.col("url"), F.col("dedupe"), F.col("html")))


def proclamation(parses: DataFrame, as_of: Column) -> DataFrame:
    """From parses of proclamation pages (url, items, ...) the first item whose headline is half-staff and that covers the day: no row or one, as FEDERAL."""
    rows = parses.select(F.posexplode("items").alias("at", "x")).select("at", "x.*")
    live = F.coalesce(covers(F.coalesce("span.start_date", "date"), F.col("span.end_date"), as_of)["verdict"], F.lit(False))
    null = F.lit(None)
    found = F.struct(
        F.lit(HALF).alias("status"), F.lit("full-day").alias("scope"), F.col("title").alias("reason"), null.alias("detail"), F.lit("presidential proclamation").alias("authority"), null.alias("citation"), F.col("url").alias("source_url"), F.col("span.end_date").alias("end_date"),
    ).cast(FEDERAL)
    return rows.filter((F.col("status") == HALF) & live).agg(F.min_by(found, "at").alias("f")).filter("f IS NOT NULL").select("f.*")


def federal(calendar: DataFrame, parses: DataFrame | None, as_of: Column) -> DataFrame:
    """The statutory observance of the day, else a proclamation: no row or one, with the columns of FEDERAL."""
    have = calendar.columns
    some = lambda c: F.col(c) if c in have else F.lit(None)
    observed = F.struct(
        F.lit(HALF).alias("status"), some("scope").alias("scope"), (F.coalesce("name", "reason") if "name" in have else F.col("reason")).alias("reason"), (some("reason") if "name" in have else F.lit(None)).alias("detail"),
        F.lit("statute").alias("authority"), some("citation").alias("citation"), F.lit(None).alias("source_url"), F.lit(None).alias("end_date"),
    ).cast(FEDERAL)
    found = resolve.statutory_observance(calendar, as_of).select(observed.alias("f"), F.lit(0).alias("rank"))
    if parses is not None:
        found = found.unionByName(proclamation(parses, as_of).select(F.struct("*").alias("f"), F.lit(1).alias("rank")))
    return found.agg(F.min_by("f", "rank").alias("f")).filter("f IS NOT NULL").select("f.*")
