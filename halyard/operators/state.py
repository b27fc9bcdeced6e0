"""Keyed state over runs: what changed, what was last known, and how a run's rows overlay the state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _history(key: str, order: Sequence[str]):
    return Window.partitionBy(key).orderBy(*order)


def detect_changes(observations: DataFrame, key: str, order: Sequence[str], content: str, seen_at: str) -> DataFrame:
    """Beside each observation: previous content, changed, first_seen, last_changed_at.

    A first sighting is no change, but it sets last_changed_at, which carries on until the next change.
    """
    w = _history(key, order)
    before = F.lag(content).over(w)
    out = observations.withColumn("previous", before).withColumn("first_seen", F.row_number().over(w) == 1)
    out = out.withColumn("changed", F.coalesce(F.col("previous") != F.col(content), F.lit(False)))
    stamp = F.when(F.col("changed") | F.col("first_seen"), F.col(seen_at))
    return out.withColumn("last_changed_at", F.last(stamp, ignorenulls=True).over(w))


def last_known_good(observations: DataFrame, key: str, order: Sequence[str], value: str, failed: Column) -> DataFrame:
    """known and coverage: the value of the latest observation that did not fail, stale where that is not this one."""
    w = _history(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = observations.withColumn("known", F.last(F.when(~failed, F.col(value)), ignorenulls=True).over(w))
    coverage = F.when(~failed, "covered").when(F.col("known").isNotNull(), "stale").otherwise("not_covered")
    return out.withColumn("coverage", coverage).withColumn("known", F.coalesce("known", F.lit("unknown")))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value_cols: Sequence[str]) -> DataFrame:
    """The row of each key that comes last by `order`, which must tell rows apart. One partial aggregate, no sort."""
    best = F.max_by(F.struct(*value_cols), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def upsert(state: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The state with new rows laid over it: a key's new row replaces the old one as a whole."""
    a, b = state.select(key, F.struct(*cols).alias("old")), new.select(key, F.struct(*cols).alias("new"))
    joined = a.join(b, key, "full_outer").withColumn("row", F.coalesce("new", "old"))
    return joined.select(key, *[F.col(f"row.{c}").alias(c) for c in cols])


def to_parse(documents: DataFrame, state: DataFrame, version: int) -> DataFrame:
    """Documents (key, hash, ...) that the state has not parsed yet in this version. Verdicts by date are never kept, only parses."""
    known = state.filter(F.col("parser_version") == version).select("key", "hash")
    return documents.join(known, ["key", "hash"], "left_anti")


def changed_feed(observations: DataFrame, key: str, at: str, content: str, reason: str | None = None) -> DataFrame:
    """The append-only log: key, at, value (and reason) of the rows that changed."""
    more = [F.col(reason).alias("reason")] if reason else []
    return observations.filter("changed").select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(content).alias("value"), *more)
