"""Text made from columns of the test tables, so that its ground truth is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choose(selector: Column, options: tuple) -> Column:
    """options[selector mod their number]."""
    out = None
    for i, o in enumerate(options):
        o = o if isinstance(o, Column) else F.lit(o)
        hit = selector % len(options) == i
        out = F.when(hit, o) if out is None else out.when(hit, o)
    return out


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")


def orders(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("day", F.to_date("o_orderdate"))


def case_sql(selector: str, options: tuple) -> str:
    """The same choice as SQL over literals; None is null."""
    show = lambda o: "NULL" if o is None else "'" + str(o).replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {selector} % {len(options)} = {i} THEN {show(o)}" for i, o in enumerate(options)) + " END"
