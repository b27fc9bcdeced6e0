"""Keyed patches of a dimension: per-column overlays and removals, later patches first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_patches(patches: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One patch per key of patches (key, seq, cols..., removed array): each column from the latest patch that sets or removes it."""

    def latest(c: str):
        says = F.col(c).isNotNull() | F.array_contains(F.coalesce("removed", F.array().cast("array<string>")), c)
        return F.max(F.when(says, F.struct("seq", F.col(c).alias("v")))).alias(c)

    merged = patches.groupBy(key).agg(*[latest(c) for c in cols])
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(f"{c}.v").isNull(), F.lit(c)) for c in cols]))
    return merged.withColumn("removed", gone).select(key, *[F.col(f"{c}.v").alias(c) for c in cols], "removed")


def apply_patches(base: DataFrame, patches: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """base with merged patches laid over it; a removed column becomes null, keys that base lacks are not inserted."""
    p = merge_patches(patches, key, cols).select(key, F.struct(*cols, "removed").alias("__p"))
    out = base.join(p, key, "left")
    return out.withColumns({c: F.when(F.array_contains("__p.removed", c), F.lit(None)).otherwise(F.coalesce(F.col(f"__p.{c}"), F.col(c))) for c in cols}).drop("__p")
