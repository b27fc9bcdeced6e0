"""What held when: validity intervals from a log of changes, and look-ups at a point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.operators.coverage import covered_days


def validity(log: DataFrame, key: str, at: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """key, values, valid_from, valid_to: the closed-open intervals in which a key had these values; the last one is open (valid_to null).

    log tells a key's values from `at` on; of rows of one time the last by `tie` counts (by the values,
    where that tells no two apart). Rows that repeat what held before end no interval. Rows without a
    time are ignored; a null key is a key.
    """
    told = F.struct(*values)
    rows = log.filter(F.col(at).isNotNull()).groupBy(key, at).agg(F.max_by(told, F.struct(*tie, *values)).alias("__v"))
    w = Window.partitionBy(key).orderBy(at)
    first = F.row_number().over(w) == 1
    moved = rows.withColumn("__new", first | ~F.col("__v").eqNullSafe(F.lag("__v").over(w))).filter("__new")
    return moved.select(key, "__v.*", F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"))


def value_at(points: DataFrame, log: DataFrame, key: str, at: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """points (key, at, ...) with the values that the log tells for their key at their time, inclusive: null before its first row.

    An as-of join in one shuffle: both sides in one window per key, in the order of time.
    """
    told = log.filter(F.col(at).isNotNull()).groupBy(key, at).agg(F.max_by(F.struct(*values), F.struct(*tie, *values)).alias("__v"))
    kind = told.schema["__v"].dataType
    asked = points.select(key, at, F.lit(None).cast(kind).alias("__v"), F.struct(*points.columns).alias("__p"))
    both = told.select(key, at, "__v", F.lit(None).cast(asked.schema["__p"].dataType).alias("__p")).unionByName(asked)
    w = Window.partitionBy(key).orderBy(F.col(at), F.col("__p").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__p IS NOT NULL")
    return found.select("__p.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def on_days(intervals: DataFrame, days: DataFrame, day: str, end: Column) -> DataFrame:
    """Intervals of validity() (in dates) joined to every day of `days` on which they hold; open ones hold until `end`, inclusive.

    An equi-join by buckets of days: a key has a row for each day asked for, whatever the log's length.
    """
    closed = intervals.withColumn("__last", F.coalesce(F.date_sub("valid_to", 1), end))
    return covered_days(closed, days, "valid_from", "__last", day).drop("__last")
