"""Which key does a message belong to? By sender domain, then account slug, then a name in its subject.

The dimensions (hints, accounts, names) have a row or a few per key. Each becomes one array on one row,
which is searched within a message's row: messages are neither shuffled nor multiplied. That is for
dimensions of up to MOST_SCANNED rows, which is checked; attributed_by_index is for larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.operators.resolve import at_most


MOST_SCANNED = 10_000  # rows of a dimension in one array; for more there is attributed_by_index


def _with_list(messages: DataFrame, rows: DataFrame, order: list, name: str) -> DataFrame:
    """messages with one more column, the rows of a dimension as an array in this order; no row gives an empty array."""
    one = at_most(rows, MOST_SCANNED).agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))
    return messages.join(F.broadcast(one), how="left")  # a table of one row


def _by_domain(messages: DataFrame, hints: DataFrame) -> DataFrame:
    """d: (code, how) of the first hint (priority, domain, code) whose domain the sender contains."""
    sender = F.lower(F.coalesce("sender", F.lit("")))
    hit = F.get(F.filter("__hints", lambda h: F.contains(sender, h["domain"])), 0)
    found = F.when(hit.isNotNull(), F.struct(hit["code"].alias("code"), F.concat(F.lit("sender domain "), hit["domain"]).alias("how")))
    return _with_list(messages, hints, ["priority", "code", "domain"], "__hints").withColumn("__d", found).drop("__hints")


def _by_account(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """a: (code, how) of the first account (priority, slug, code) whose slug stands as a word in sender or headers."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("sender", F.lit("")), F.col("headers")))
    word = lambda slug: F.concat(F.lit("(?U)\\b\\Q"), slug, F.lit("\\E\\b"))
    # most slugs are not even part of the text, which is told without a pattern
    hit = F.get(F.filter("__accounts", lambda a: F.contains(F.col("__hay"), a["slug"]) & F.regexp_like(F.col("__hay"), word(a["slug"]))), 0)
    found = F.when(hit.isNotNull(), F.struct(hit["code"].alias("code"), F.concat(F.lit("govdelivery account "), F.upper(hit["slug"])).alias("how")))
    rows = _with_list(messages.withColumn("__hay", hay), accounts.filter("slug <> ''"), ["priority", "code", "slug"], "__accounts")
    return rows.withColumn("__a", found).drop("__accounts", "__hay")


def _by_subject(messages: DataFrame, names: DataFrame) -> DataFrame:
    """s: a key is accepted only if the subject contains exactly one of names (code, name); else how tells why not."""
    subject = F.lower(F.coalesce("subject", F.lit("")))
    rows = _with_list(messages, names.filter("name IS NOT NULL"), ["code", "name"], "__names")
    rows = rows.withColumn("__in", F.filter("__names", lambda x: F.contains(subject, F.lower(x["name"]))))
    n = F.size("__in")
    how = F.when(n == 1, "state named in subject").when(n > 1, F.concat(F.lit("subject names "), n.cast("string"), F.lit(" states - ambiguous"))).otherwise("no state identified")
    return rows.withColumn("__s", F.struct(F.when(n == 1, F.get("__in", 0)["code"]).alias("code"), how.alias("how"))).drop("__names", "__in")


def attributed(messages: DataFrame, hints: DataFrame, accounts: DataFrame, names: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """messages with code and how: identity before mention. allowed (code), if any, limits the keys of all three."""
    if allowed is not None:
        hints, accounts, names = (d.join(allowed, "code", "left_semi") for d in (hints, accounts, names))
    out = _by_subject(_by_account(_by_domain(messages, hints), accounts), names)
    best: Column = F.coalesce("__d", "__a", "__s")
    return out.withColumns({"code": best["code"], "how": best["how"]}).drop("__d", "__a", "__s")


def attribute(messages: DataFrame, hints: DataFrame, accounts: DataFrame, names: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """msg_id, code, how for every message."""
    return attributed(messages, hints, accounts, names, allowed).select("msg_id", "code", "how")


def attributed_by_index(messages: DataFrame, hints: DataFrame, accounts: DataFrame, names: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """attributed() for very many hints, accounts and names: messages meet them by an inverted index; msg_id must tell messages apart.

    Only the texts that are searched are exploded, and only what was found is joined back.
    """
    from halyard.operators.containment import first_contained

    if allowed is not None:
        hints, accounts, names = (d.join(allowed, "code", "left_semi") for d in (hints, accounts, names))
    sender, subject = F.lower(F.coalesce("sender", F.lit(""))), F.lower(F.coalesce("subject", F.lit("")))
    texts = messages.select("msg_id", sender.alias("__sender"), F.concat_ws(" ", sender, F.lower("headers")).alias("__hay"), subject.alias("__subject"))
    word = F.regexp_like(F.col("__hay"), F.concat(F.lit("(?U)\\b\\Q"), F.col("slug"), F.lit("\\E\\b")))
    d = first_contained(texts, "msg_id", "__sender", hints.select("priority", "code", "domain"), "domain", ["priority", "code", "domain"])
    a = first_contained(texts, "msg_id", "__hay", accounts.select("priority", "code", "slug"), "slug", ["priority", "code", "slug"], word)
    s = first_contained(texts, "msg_id", "__subject", names.select("code", F.lower("name").alias("name")), "name", ["code", "name"])
    told = lambda rows, name: rows.select("msg_id", F.col("__first").alias(name), F.col("__n").alias(f"{name}_n"))
    out = messages.join(told(d, "__d"), "msg_id", "left").join(told(a, "__a"), "msg_id", "left").join(told(s, "__s"), "msg_id", "left")
    n = F.coalesce("__s_n", F.lit(0))
    code = F.coalesce("__d.code", "__a.code", F.when(n == 1, F.col("__s.code")))
    how = (
        F.when(F.col("__d").isNotNull(), F.concat(F.lit("sender domain "), F.col("__d.domain")))
        .when(F.col("__a").isNotNull(), F.concat(F.lit("govdelivery account "), F.upper("__a.slug")))
        .when(n == 1, "state named in subject")
        .when(n > 1, F.concat(F.lit("subject names "), n.cast("string"), F.lit(" states - ambiguous")))
        .otherwise("no state identified")
    )
    return out.withColumns({"code": code, "how": how}).select(*messages.columns, "code", "how")


def unattributed(messages: DataFrame, shown: int = 2, chars: int = 70) -> DataFrame:
    """sender_domain, n, subjects: messages per domain with their first distinct subjects by seq."""
    from halyard.functions.text import sender_domain

    rows = messages.select(sender_domain(F.col("sender")).alias("sender_domain"), "seq", F.left("subject", F.lit(chars)).alias("subject"))
    first = rows.groupBy("sender_domain", "subject").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    # ranks are limited before the shuffle, so no more than `shown` subjects a domain and task are held or moved
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("sender_domain").orderBy("seq", "subject"))).filter(F.col("rank") <= shown)
    subjects = F.transform(F.array_sort(F.collect_list(F.struct("rank", "subject"))), lambda x: x["subject"])
    top = ranked.groupBy("sender_domain").agg(subjects.alias("subjects"))
    return first.groupBy("sender_domain").agg(F.sum("n").alias("n")).join(top, "sender_domain")
