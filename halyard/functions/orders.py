"""The record of one order, from its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.functions.dates import date_range
from halyard.functions.rules import GOVERNOR, HALF, classify_authority, classify_status
from halyard.functions.text import bind, until_noon

TITLE_CHARS = 200


def extract_order(text: Column, url: Column, title: Column) -> Column:
    """struct: title, url, status, authority, dates, until_noon, evidence, and whether it can stand as a state's own order."""
    told = F.struct(classify_status(text).alias("status"), classify_authority(text).alias("authority"), date_range(text).alias("dates"))

    def of(v: Column) -> Column:
        status, authority, dates = v["status"], v["authority"], v["dates"]
        return F.struct(
            F.nullif(F.left(title, F.lit(TITLE_CHARS)), F.lit("")).alias("title"),
            url.alias("url"),
            status["value"].alias("status"),
            authority["value"].alias("authority"),
            dates["start_date"].alias("start_date"),
            dates["end_date"].alias("end_date"),
            until_noon(text).alias("until_noon"),
            status["evidence"].alias("status_evidence"),
            authority["evidence"].alias("authority_evidence"),
            ((status["value"] == HALF) & (authority["value"] == GOVERNOR)).alias("usable_as_state_order"),
        )

    return bind(told, of)
