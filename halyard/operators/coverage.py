"""Does an order provably cover a day? True, false, or null where that cannot be told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRACE_DAYS = 2
LOOKBACK_DAYS = 21
FROZEN_DAYS = 180


def covers(start: Column, end: Column, day: Column, grace: int = GRACE_DAYS) -> Column:
    """struct(verdict, why). Windows are closed; a start without end is live for `grace` days."""
    age = F.datediff(day, start)
    s, e = start.isNotNull(), end.isNotNull()
    text = lambda c: c.cast("string")
    verdict = (
        F.when(s & e, (start <= day) & (day <= end)).when(e, day <= end).when(s & (start == day), True).when(s & (start > day), False).when(s, age <= grace).otherwise(F.lit(None).cast("boolean"))
    )
    why = (
        F.when(s & e, F.concat(F.lit("window "), text(start), F.lit(".."), text(end)))
        .when(e, F.concat(F.lit("ends "), text(end)))
        .when(s & (start == day), F.concat(F.lit("order dated "), text(start)))
        .when(s & (start > day), F.concat(F.lit("scheduled for "), text(start), F.lit(", not yet active")))
        .when(s & (age <= grace), F.concat(F.lit("order dated "), text(start), F.lit(" ("), text(age), F.lit("d ago), no stated end - treated as live")))
        .when(s, F.concat(F.lit("started "), text(start), F.lit(", no end date, "), text(age), F.lit("d old, presumed concluded")))
        .otherwise("no dates parsed")
    )
    return F.struct(verdict.alias("verdict"), why.alias("why"))


def recent(date: Column, as_of: Column, days: int = LOOKBACK_DAYS) -> Column:
    """Not older than `days`; undated rows stay."""
    return date.isNull() | (date >= F.date_sub(as_of, days))


def freshness(modified: Column, as_of: Column, days: int = FROZEN_DAYS) -> Column:
    """struct(age_days, freshness_unknown, frozen) of a page last modified then."""
    age = F.datediff(as_of, modified)
    return F.struct(age.alias("age_days"), modified.isNull().alias("freshness_unknown"), F.coalesce(age > days, F.lit(False)).alias("frozen"))


def covered_days(orders: DataFrame, days: DataFrame, start: str, end: str, day: str, width: int = 32) -> DataFrame:
    """orders joined to every day of `days` within their closed window.

    A range join as an equi-join: a window is listed under each bucket of `width` days that it touches,
    a day under its one bucket. Windows without start or end, or that end before they start, cover nothing.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    left = orders.filter(F.col(start) <= F.col(end)).withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    right = days.filter(F.col(day).isNotNull()).withColumn("__bucket", bucket(F.col(day)))
    return left.join(right, "__bucket").filter(F.col(day).between(F.col(start), F.col(end))).drop("__bucket")
