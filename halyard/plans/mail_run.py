"""The mail run: from a mailbox and the registry to the orders, channels and unknown senders that the status run reads.

Its state is a store of versions of its own. A run without mail (no access, say) commits nothing, so
what was known stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators import attribution, messages
from halyard.sources.versions import Store, Version

KEY = "state_code"
DAYS = 14  # how far back a mailbox is read
# Sender domains seen on real bulletins, and the keys they belong to, in the order in which they are tried.
SENDER_HINTS = (
    ("subscriptions.kentucky.gov", "KY"),
    ("govsubscriptions.michigan.gov", "MI"),
    ("wyo.gov", "WY"),
    ("wyoming.gov", "WY"),
    ("mt.gov", "MT"),
    ("montana.gov", "MT"),
    ("nh.gov", "NH"),
    ("illinois.gov", "IL"),
    ("state.mn.us", "MN"),
    ("mn.gov", "MN"),
    ("idaho.gov", "ID"),
    ("governor.ks.gov", "KS"),
    ("ks.gov", "KS"),
    ("state.ma.us", "MA"),
    ("mass.gov", "MA"),
    ("az.gov", "AZ"),
    ("oregon.gov", "OR"),
    ("maryland.gov", "MD"),
    ("michigan.gov", "MI"),
    ("ky.gov", "KY"),
)
ACCOUNT = r"/accounts/([A-Za-z0-9_-]+)/"  # fixed value: the account in a channel's address
ORDERS = "state_code string, msg_id string, seq long, title string, sender string, sent_date date, start_date date, end_date date, until_noon boolean, authority string, identified_by string, status string, evidence string"
SEEN = "state_code string, seen_on date"


def _last_wins(rows: DataFrame, name: str) -> DataFrame:
    """(priority, name, code) with one row a name: the code of its last row, at the place of its first."""
    return rows.groupBy(name).agg(F.min("at").alias("priority"), F.max_by("code", "at").alias("code")).select("priority", name, "code")


def dimensions(registry: DataFrame, order: str = KEY) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """hints, accounts, names and allowed keys, as attribution wants them, from the registry.

    A domain that the registry expects replaces the built-in key of that domain, or comes after the
    built-in ones; accounts stand in the addresses of channels. `order` is the column by which rows of
    the registry come first. Keys that are told by mail, or have a channel, are allowed.
    """
    rows = registry.select(F.col(KEY).alias("code"), "state", "ingest_mode", "notification_channel", "expected_sender_domain", F.col(order).cast("string").alias("by"))
    spark = registry.sparkSession
    built_in = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{d}', '{c}')" for i, (d, c) in enumerate(SENDER_HINTS)) + " AS h(i, domain, code)")
    at = lambda rank, by: F.struct(rank.alias("rank"), by.alias("by"))
    own = F.lower(F.trim(F.coalesce("expected_sender_domain", F.lit(""))))
    hints = built_in.select("domain", "code", at(F.col("i"), F.lit("")).alias("at")).unionByName(rows.filter(own != "").select(own.alias("domain"), "code", at(F.lit(len(SENDER_HINTS)), F.col("by")).alias("at")))
    slug = F.lower(F.regexp_extract(F.coalesce("notification_channel.detail", F.lit("")), ACCOUNT, 1))
    accounts = rows.withColumn("slug", slug).filter("slug <> ''").select("slug", "code", at(F.lit(0), F.col("by")).alias("at"))
    allowed = rows.filter((F.col("ingest_mode") == "email") | F.col("notification_channel").isNotNull()).select("code").distinct()
    return _last_wins(hints, "domain"), _last_wins(accounts, "slug"), rows.select("code", F.col("state").alias("name")), allowed


def advance(store: Store, mailbox: DataFrame | None, registry: DataFrame, batch: str, order: str = KEY) -> Version | None:
    """One run over the messages of read_mailbox(): commits orders, seen, unattributed and rejected.

    orders are those of the messages given, the last of each key; seen is what was known of channels,
    and the day of each key's last accepted message. mailbox None means that mail could not be read:
    the last version is returned, and nothing is written. A batch that is committed already is not run again.
    """
    last = store.latest()
    if mailbox is None or last and last.batch == batch:
        return last
    draft = store.begin(batch)
    hints, accounts, names, allowed = dimensions(registry, order)
    parsed = messages.parse_messages(mailbox, hints, accounts, names, allowed)
    parsed = draft.keep(parsed, "parsed")
    orders = messages.latest_orders(parsed).withColumnRenamed("subject", "title")
    draft.keep(orders.select(*[f.split()[0] for f in ORDERS.split(", ")]), "orders")
    before = last.table("seen") if last else store.spark.createDataFrame([], SEEN)
    draft.keep(messages.channels_seen(parsed, before).select(KEY, F.col("seen_on").cast("date").alias("seen_on")), "seen")
    draft.keep(attribution.unattributed(parsed.filter(F.col("reason") == "no state identified")), "unattributed")
    draft.keep(messages.reject_reasons(parsed.filter(F.col("reason") != "not flag-related")), "rejected")
    return draft.commit("orders", "seen", "unattributed", "rejected")


def told_by_mail(store: Store) -> tuple[DataFrame, DataFrame]:
    """orders and seen of the last committed run, as the status run reads them; empty before the first."""
    last = store.latest()
    if last is None:
        return store.spark.createDataFrame([], ORDERS), store.spark.createDataFrame([], SEEN)
    return last.table("orders"), last.table("seen")
