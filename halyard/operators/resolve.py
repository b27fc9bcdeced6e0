"""From candidates to one status per key: folds, per-mode resolution, overlays and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.dates import advertised_window, page_last_modified
from halyard.functions.rules import FULL, GOVERNOR, HALF, UNKNOWN, classify_authority, county_exceptions, current_status, toggle_status
from halyard.functions.text import bind, or_else, status_fingerprint
from halyard.operators.coverage import covers, freshness, recent


def of_keys(registry: DataFrame, key: str, wanted: str | None) -> DataFrame:
    """The registry, or its row for one key, in whatever case that is given."""
    return registry if wanted is None else registry.filter(F.col(key) == F.upper(F.lit(wanted)))


def buildable_count(registry: DataFrame) -> DataFrame:
    """One row: buildable (true, not null), total."""
    return registry.agg(F.count_if(F.coalesce("buildable", F.lit(False))).alias("buildable"), F.count("*").alias("total"))


def half_and_changed(rows: DataFrame, key: str) -> DataFrame:
    """One row: the sorted keys at half-staff and the sorted keys that changed. For no more than MOST_IN_A_ROW keys, which is checked before they are collected."""
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(key))))
    return at_most(rows, MOST_IN_A_ROW).agg(some(F.col("effective_status") == HALF).alias("half"), some(F.col("changed")).alias("changed"))


MOST_IN_A_ROW = 1_000_000


def at_most(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or an error when they are read if there are more than `most`."""
    n = rows.agg(F.count("*").alias("__n"))
    return rows.join(F.broadcast(n), how="left").withColumn("__ok", F.assert_true(F.col("__n") <= most, F.lit(f"more than {most} rows for one row"))).filter("__ok IS NULL").drop("__n", "__ok")


def pick_url(row: Column) -> Column:
    """The URL to fetch of a registry struct, by its ingest mode; an empty string counts as missing."""
    mode = row["ingest_mode"]
    return (
        F.when(mode == "email", F.lit(None).cast("string"))
        .when(mode == "toggle", or_else(row["toggle_hub_url"], row["press_url"]))
        .when(mode == "feed", or_else(row["rss_url"]))
        .when(mode.isin("archive", "diff"), or_else(row["flag_page_url"], row["press_url"]))
        .otherwise(or_else(row["press_url"], row["flag_page_url"]))
    )


def known_or_own(value: Column, key: Column) -> Column:
    """value to join by; where it is null a value of the row's own that meets nothing, so that such rows are not all dealt to one task."""
    return F.coalesce(value, F.concat(F.lit("\0"), key.cast("string")))


def with_alternates(registry: DataFrame, documents: DataFrame, key: str = "state_code") -> DataFrame:
    """Each registry row (key, url, url_candidates) with the first of its URLs that was fetched well.

    documents: url, html, error, one row a URL. The primary comes first, then the candidates but the
    primary; html and used_url are null, and error is the primary's, where none succeeds. The URL is
    chosen without any html; only the chosen ones are joined to theirs. Both sides have a row for each key, so none is broadcast.
    """
    urls = F.concat(F.array("url"), F.filter(F.coalesce("url_candidates", F.array().cast("array<string>")), lambda u: u != F.coalesce(F.col("url"), F.lit(""))))
    tries = registry.select(key, F.posexplode(urls).alias("pos", "try")).filter("try IS NOT NULL")
    outcome = documents.select(F.col("url").alias("try"), (F.col("error").isNull() & F.col("html").isNotNull()).alias("good"), "error")
    got = tries.join(outcome.hint("merge"), "try", "left")
    good = F.coalesce("good", F.lit(False))
    best = got.groupBy(key).agg(
        F.min_by(F.when(good, F.col("try")), F.when(good, F.col("pos"))).alias("used_url"),
        F.min_by(F.coalesce("error", F.lit("not fetched")), F.when(F.col("pos") == 0, 0)).alias("primary_error"),
    )
    out = registry.join(best.hint("merge"), key, "left").withColumn("__at", known_or_own(F.col("used_url"), F.col(key)))
    out = out.join(documents.select(F.col("url").alias("__at"), "html").hint("merge"), "__at", "left").drop("__at")
    error = F.when(F.col("used_url").isNull(), F.when(F.col("url").isNull(), "no url").otherwise(F.col("primary_error")))
    return out.withColumn("error", error).drop("primary_error")


def fold_candidates(items: DataFrame, key: str, as_of: Column, signature_required: Column | None = None, shown: Sequence[str] = ()) -> DataFrame:
    """One verdict per key from its items (key, ordinal, title, date, status, authority, scope, start_date, end_date).

    Items older than the look-back, not at half-staff, of limited scope, or (where required) without a
    governor's authority are passed over. The first that covers the day makes the key half; else the
    first that does not is kept as expired and the key is full. limited lists the limited orders before
    the one taken. shown are further columns of items that orders carry. A row without a title only says
    that its key has items: they are of no use, so the key is full.
    """
    start = F.coalesce("start_date", "date")
    usable = (F.col("status") == HALF) & recent(F.col("date"), as_of)
    if signature_required is not None:
        usable = usable & (~signature_required | (F.col("authority") == GOVERNOR))
    limited = (F.col("status") == HALF) & recent(F.col("date"), as_of) & (F.col("scope") == "limited")
    rows = items.withColumns({"start_date": start, "limited": limited, "usable": usable & (F.col("scope") != "limited")}).withColumn("covers", covers(F.col("start_date"), F.col("end_date"), as_of))
    taken = F.struct((~F.coalesce(F.col("covers.verdict"), F.lit(False))).alias("not_live"), "ordinal")
    order = F.struct("title", "start_date", "end_date", "authority", F.col("covers.why").alias("why"), F.coalesce(F.col("covers.verdict"), F.lit(False)).alias("live"), "ordinal", *shown)
    out = rows.groupBy(key).agg(
        F.min_by(F.when(F.col("usable"), order), F.when(F.col("usable"), taken)).alias("order"),
        F.array_sort(F.collect_list(F.when(F.col("limited"), F.struct("ordinal", "title", *[c for c in ("url", "scope_evidence") if c in items.columns])))).alias("limited"),
    )
    live = F.coalesce(F.col("order.live"), F.lit(False))
    before = F.filter("limited", lambda x: ~live | (x["ordinal"] < F.col("order.ordinal")))
    return out.select(
        key, F.when(live, HALF).otherwise(FULL).alias("status"), F.when(live, F.col("order")).alias("order"), F.when(~live, F.col("order")).alias("last_expired_order"), before.alias("limited_orders")
    )


def verdict_of_page(declared: Column, span: Column, modified: Column, authority: Column, signature_required: Column, as_of: Column) -> Column:
    """struct: status, coverage, error, ended, why, age_days, freshness_unknown of a current-status page on a day, from what it says.

    A page that has not changed for too long is unknown and stale; half-staff whose advertised window
    does not cover the day is full; half-staff without the governor's authority, where that is asked for, is unknown.
    """
    facts = F.struct(freshness(modified, as_of).alias("fresh"), covers(span["start_date"], span["end_date"], as_of).alias("covers"))

    def of(v: Column) -> Column:
        frozen, half = v["fresh"]["frozen"], declared == HALF
        ended = half & F.coalesce(v["covers"]["verdict"] == F.lit(False), F.lit(False))
        unsigned = half & ~ended & F.coalesce(signature_required, F.lit(False)) & ~F.coalesce(authority == GOVERNOR, F.lit(False))
        age = v["fresh"]["age_days"].cast("string")
        told = F.when(frozen, F.concat(F.lit("source appears frozen: newest date on page is "), modified.cast("string"), F.lit(" ("), age, F.lit("d old) - not trusted")))
        told = told.when(unsigned, F.concat(F.lit("authority unproven ("), F.coalesce(authority, F.lit(UNKNOWN)), F.lit("); not claimed as state order")))
        return F.struct(
            F.when(frozen, UNKNOWN).when(ended, FULL).when(unsigned, UNKNOWN).otherwise(declared).alias("status"), F.when(frozen, "stale").otherwise("covered").alias("coverage"), told.alias("error"),
            (~frozen & ended).alias("ended"), v["covers"]["why"].alias("why"), v["fresh"]["age_days"].alias("age_days"), v["fresh"]["freshness_unknown"].alias("freshness_unknown"), frozen.alias("frozen"),
        )

    return bind(facts, of)


def status_pages(pages: DataFrame, as_of: Column, signature_required: str = "signature_check_required") -> DataFrame:
    """Status of current-status pages (html, ...): value, evidence, freshness and counties beside each page."""
    html = F.col("html")
    out = pages.withColumns({"declared": current_status(html), "window": advertised_window(html), "modified": page_last_modified(html, as_of), "by": classify_authority(html)["value"]})
    verdict = verdict_of_page(F.col("declared.value"), F.col("window"), F.col("modified"), F.col("by"), F.col(signature_required), as_of)
    out = out.withColumn("verdict", verdict)
    return out.withColumns({"status": F.col("verdict.status"), "coverage": F.col("verdict.coverage"), "error": F.col("verdict.error"), "evidence": F.col("declared.evidence"), "county_exceptions": county_exceptions(html)}).drop("declared", "by", "verdict")


def observed_pages(pages: DataFrame, previous: DataFrame | None, key: str, hint: str | None = None) -> DataFrame:
    """pages (key, html) with fingerprint, changed and first_seen against the fingerprints (key, fingerprint) of the last run."""
    out = pages.withColumn("fingerprint", status_fingerprint(F.col("html"), hint))
    if previous is None:
        return out.withColumns({"changed": F.lit(False), "first_seen": F.lit(True)})
    out = out.join(previous.select(key, F.col("fingerprint").alias("__before")), key, "left")
    return out.withColumns({"changed": F.coalesce(F.col("__before") != F.col("fingerprint"), F.lit(False)), "first_seen": F.col("__before").isNull()}).drop("__before")


def failing_sources(rows: DataFrame) -> DataFrame:
    """Rows to warn of: an error on a source that should be covered, or a stale one."""
    return rows.filter(((F.coalesce("error", F.lit("")) != "") & (F.col("coverage") != "not_covered")) | (F.col("coverage") == "stale"))


def toggle_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("t", toggle_status(F.col("html"))).withColumns({"status": F.col("t.value"), "evidence": F.col("t.evidence"), "coverage": F.lit("covered")}).drop("t")


# What is said of a channel that has never delivered, and of a key without a source.
NEVER_HEARD = "subscription pending - no bulletin received from this channel yet"
NO_SOURCE = "no verified source for this jurisdiction"
NO_ITEMS = "source readable but no items parsed"


def email_status(registry: DataFrame, orders: DataFrame, seen: DataFrame, as_of: Column, key: str = "state_code") -> DataFrame:
    """Status of keys that are told by e-mail: orders (key, start_date, end_date), seen (key, seen_on).

    Without an order a channel that has been heard means full; one that never was means unknown.
    """
    out = registry.select(key).join(orders.select(key, "start_date", "end_date", F.lit(True).alias("has_order")), key, "left").join(seen.select(key, "seen_on"), key, "left")
    live = F.coalesce(covers(F.col("start_date"), F.col("end_date"), as_of)["verdict"], F.lit(False))
    has, heard = F.col("has_order").isNotNull(), F.col("seen_on").isNotNull()
    return out.select(
        key,
        F.when(has & live, HALF).when(has | heard, FULL).otherwise(UNKNOWN).alias("status"),
        F.when(has | heard, "covered").otherwise("not_covered").alias("coverage"),
        F.when(~has & ~heard, NEVER_HEARD).alias("error"),
        F.when(~has, F.col("seen_on")).alias("channel_last_heard"),
    )


def statutory_observance(calendar: DataFrame, day: Column) -> DataFrame:
    """The first active observance of that day, by ordinal: no row or one."""
    hit = calendar.filter(F.col("active") & (F.col("date") == day))
    cols = [c for c in calendar.columns if c != "ordinal"]
    return hit.agg(F.min_by(F.struct(*cols), "ordinal").alias("o")).filter("o IS NOT NULL").select("o.*")


def observances_of_days(calendar: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """days with the columns of the first active observance of each (by ordinal); days without one are left out."""
    cols = [c for c in calendar.columns if c not in ("ordinal", "date", "active")]
    first = calendar.filter("active AND date IS NOT NULL").groupBy("date").agg(F.min_by(F.struct(*cols), "ordinal").alias("o"))
    return days.join(first.withColumnRenamed("date", day), day).select(*days.columns, "o.*")


def overlay(states: DataFrame, federal: DataFrame) -> DataFrame:
    """states (status, order_title, until_noon, ...) under a federal observance (reason, scope) of no row or one."""
    fed = federal.select(F.coalesce("scope", F.lit("full-day")).alias("__scope"), F.col("reason").alias("__reason"), F.lit(True).alias("__fed"))
    out = states.join(F.broadcast(fed), F.lit(True), "left")
    on, half = F.coalesce(F.col("__fed"), F.lit(False)), F.col("status") == HALF
    return out.withColumns(
        {
            "effective_status": F.when(on | half, HALF).when(F.col("status") == FULL, FULL).otherwise(UNKNOWN),
            "reason": F.when(on, F.col("__reason")).when(half, F.coalesce("order_title", F.lit("State order"))),
            "reason_source": F.when(on, "federal").when(half, "state"),
            "scope": F.when(on, F.col("__scope")).when(half, F.when(F.col("until_noon"), "until-noon").otherwise("full-day")),
        }
    ).drop("__scope", "__reason", "__fed")


def coverage_counts(rows: DataFrame) -> DataFrame:
    """One row: covered, not_covered, stale, errors, total."""
    counts = [F.count_if(F.col("coverage") == c).alias(c) for c in ("covered", "not_covered", "stale")]
    return rows.agg(*counts, F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.count("*").alias("total"))


# Causes of errors, in the order in which they are tried.
CAUSES = (
    ("(?i)robots", "blocked by robots.txt"),
    ("HTTP [45]", "HTTP error"),
    ("(?i)timeout", "timeout"),
    ("(?i)frozen", "frozen source"),
    ("(?i)no verified source", "no source"),
    ("(?i)no items parsed", "parsed nothing"),
)


def error_causes(rows: DataFrame) -> DataFrame:
    """cause, n of the rows with an error, most frequent first."""
    e = F.col("error")
    cause = F.when(e.rlike(CAUSES[0][0]), CAUSES[0][1])
    for pattern, name in CAUSES[1:]:
        cause = cause.when(e.rlike(pattern), name)
    found = rows.filter(F.coalesce("error", F.lit("")) != "").select(cause.otherwise(F.left(e, F.lit(40))).alias("cause"))
    return found.groupBy("cause").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cause")


def publishable(rows: DataFrame, least: int = 20) -> DataFrame:
    """The rows, or an error when they are read if fewer than `least` are covered. Nothing is collected for it."""
    n = rows.agg(F.count_if(F.col("coverage") == "covered").alias("__n"))
    return rows.join(F.broadcast(n), how="left").withColumn("__ok", F.assert_true(F.col("__n") >= least, F.lit("too few covered to publish"))).filter("__ok IS NULL").drop("__n", "__ok")


def enrich(items: DataFrame, bodies: DataFrame, wanted: Column, on: str, cols: Sequence[str]) -> DataFrame:
    """items with columns of bodies where `wanted` holds; the condition stands in the join, so no other body is read into a row."""
    right = bodies.select(F.col(on).alias("__on"), *cols).hint("merge")
    return items.join(right, wanted & (F.col(on) == F.col("__on")), "left").drop("__on")
