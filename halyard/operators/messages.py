"""Mail messages to orders: body choice, ordered reasons for rejection, latest order and last word per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.dates import date_range, mail_date
from halyard.functions.rules import HALF, UNKNOWN, classify_authority, classify_status
from halyard.functions.text import FLAG, order_scope, strip_html, until_noon
from halyard.operators.attribution import attributed

# Senders whose mail is never about orders.
IGNORED_SENDERS = ("accounts.google.com", "no-reply@google.com", "mail-noreply@google.com", "googlemail.com")
BODY_CHARS = 600


def choose_body(parts: Column) -> Column:
    """The longer of the first plain and the first HTML part (stripped) without a file name; plain on a tie.

    parts is array of struct(ctype, filename, text); a single part is taken as it is, stripped if it has a `<`.
    """
    own = F.filter(parts, lambda p: F.coalesce(p["filename"], F.lit("")) == "")
    part = lambda kind: F.get(F.filter(own, lambda p: p["ctype"] == kind), 0)["text"]
    plain, html = F.btrim(F.coalesce(part("text/plain"), F.lit("")), F.lit(" \t\r\n")), strip_html(part("text/html"))
    single = F.get(parts, 0)["text"]
    alone = F.when(F.contains(single, F.lit("<")), strip_html(single)).otherwise(F.coalesce(single, F.lit("")))
    return F.when(F.size(parts) == 1, alone).otherwise(F.when(F.char_length(plain) >= F.char_length(html), plain).otherwise(html))


def parse_messages(messages: DataFrame, hints: DataFrame, accounts: DataFrame, names: DataFrame, allowed: DataFrame | None = None, relevant: str = FLAG) -> DataFrame:
    """Every message (msg_id, seq, sender, subject, headers, date, parts) as an order or with the first reason against it."""
    rows = attributed(messages, hints, accounts, names, allowed).withColumn("body", choose_body(F.col("parts"))).withColumn("blob", F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.col("body")))
    rows = rows.withColumn("s1", classify_status(F.col("subject"))).withColumn("s2", classify_status(F.left("body", F.lit(BODY_CHARS))))
    rows = rows.withColumn("status", F.when(F.col("s1.value") != UNKNOWN, F.col("s1")).otherwise(F.col("s2"))).withColumn("scope", order_scope(F.col("blob"))).withColumn("dates", date_range(F.col("blob")))
    sender = F.lower(F.coalesce("sender", F.lit("")))
    ignored = F.lit(False)
    for s in IGNORED_SENDERS:
        ignored = ignored | F.contains(sender, F.lit(s))
    reason = (
        F.when(ignored | ~F.col("blob").rlike(relevant), "not flag-related")
        .when(F.col("code").isNull(), F.col("how"))
        .when(F.col("status.value") != HALF, F.concat(F.lit("no half-staff order detected ("), F.col("status.value"), F.lit(")")))
        .when(F.col("scope.scope") == "limited", F.concat(F.lit("limited scope: "), F.col("scope.evidence")))
    )
    sent = mail_date(F.col("date"))
    return rows.select(
        "msg_id", "seq", reason.alias("reason"), F.col("code").alias("state_code"), F.col("how").alias("identified_by"), F.col("status.value").alias("status"), classify_authority(F.col("blob"))["value"].alias("authority"),
        F.left("subject", F.lit(200)).alias("subject"), F.left("sender", F.lit(120)).alias("sender"), sent.alias("sent_date"), F.coalesce("dates.start_date", sent).alias("start_date"), F.col("dates.end_date").alias("end_date"),
        until_noon(F.col("blob")).alias("until_noon"), F.col("status.evidence").alias("evidence"),
    )


def latest_orders(parsed: DataFrame) -> DataFrame:
    """The accepted order of each key that was sent last; the first of those sent on one day."""
    cols = [c for c in parsed.columns if c not in ("reason", "state_code")]
    order = F.struct(F.coalesce(F.col("sent_date").cast("string"), F.lit("")), -F.col("seq"))
    return parsed.filter("reason IS NULL").groupBy("state_code").agg(F.max_by(F.struct(*cols), order).alias("o")).select("state_code", "o.*")


def channels_seen(parsed: DataFrame, prior: DataFrame) -> DataFrame:
    """state_code, seen_on: the date of the last accepted message by seq that has one, else what was known."""
    now = parsed.filter("reason IS NULL AND sent_date IS NOT NULL").groupBy("state_code").agg(F.max_by("sent_date", "seq").alias("now"))
    return now.join(prior, "state_code", "full_outer").select("state_code", F.coalesce("now", "seen_on").alias("seen_on"))


def reject_reasons(parsed: DataFrame) -> DataFrame:
    """reason, n of the messages that became no order."""
    return parsed.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")
