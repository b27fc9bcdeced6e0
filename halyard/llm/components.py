"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.scratch import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (u, v), both of one orderable type; label is the smallest node of its component.

    Every round each node takes the smallest label among its neighbours' and then that label's own
    label, so long chains halve. Rounds end when no label changes; each is a table in the shared
    folder. Neighbours' labels are combined before they are shuffled, so hubs are no hot keys. Loops
    and repeated edges do no harm; a null end is ignored; no edges give no rows.
    """
    edges = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    both = written(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = new.join(jump, "label", "left").select("node", F.coalesce(F.least("label", "further"), F.col("label")).alias("label"), "old")
        new = written(new, "labels")
        if not new.filter("label != old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
