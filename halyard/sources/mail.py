"""Mail messages as rows: RFC 822 files to headers and text parts.

A mailbox is a folder of day=YYYY-MM-DD folders, by the day on which messages arrived, of .eml files (one
message each) and mbox files. It is read by a data source of its own: a filter on day is pushed into it, so
folders of other days are neither listed nor opened. A plain folder of .eml files is read by read_messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from halyard.functions.dates import mail_date
from halyard.functions.text import decode_header

# Headers in which a mailing service names the account that sent a message.
ACCOUNT_HEADERS = ("List-Id", "List-Unsubscribe", "Return-Path", "Sender", "X-Original-Sender", "Reply-To")
SCHEMA = "msg_id string, sender string, subject string, date string, headers string, parts array<struct<ctype:string,filename:string,text:string>>"
FILES_A_TASK = 1000
_FROM = re.compile(rb"^From [^\n]*\n", re.MULTILINE)


def _message(name: str, content: bytes) -> tuple:
    """A message as a row of SCHEMA; what is no message has neither headers nor text worth reading, but is a row too."""
    import email

    msg = email.message_from_bytes(content)
    parts = []
    for part in msg.walk():
        if part.is_multipart():
            continue
        raw = part.get_payload(decode=True) or b""
        try:
            text = raw.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:  # a charset that nobody knows
            text = raw.decode("utf-8", "replace")
        parts.append({"ctype": part.get_content_type(), "filename": part.get_filename(), "text": text})
    told = [None if msg.get(h) is None else str(msg.get(h)) for h in ("From", "Subject", "Date")]
    return (name, *told, " ".join(str(msg.get(h) or "") for h in ACCOUNT_HEADERS), parts)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [_message(path, bytes(content)) for path, content in zip(pdf["path"], pdf["content"], strict=True)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def read_messages(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Messages of a folder of .eml files with decoded headers; since keeps those sent on that day or later, and undated ones.

    seq grows with the day on which a message was sent, then with its path; undated ones come first.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("path", "content")
    rows = files.mapInPandas(_parse, SCHEMA).withColumns({"sender": decode_header(F.col("sender")), "subject": decode_header(F.col("subject"))})
    rows = rows.withColumn("__sent", mail_date(F.col("date")))
    if since is not None:
        rows = rows.filter(F.col("__sent").isNull() | (F.col("__sent") >= since))
    return numbered(rows, "__sent").drop("__sent")


def numbered(rows: DataFrame, day: str) -> DataFrame:
    """rows with seq, which grows with the day, then with msg_id: ranges of the order are dealt to tasks, so no task sees all."""
    return rows.orderBy(F.col(day).asc_nulls_first(), "msg_id").withColumn("seq", F.monotonically_increasing_id())


# --- a mailbox by day -----------------------------------------------------------------------------


def messages_of_mbox(content: bytes) -> list[bytes]:
    """The messages of an mbox, each behind a line that begins with `From `."""
    cuts = [(m.start(), m.end()) for m in _FROM.finditer(content)]
    ends = [*(start for start, _ in cuts[1:]), len(content)][: len(cuts)]
    return [content[begin:end] for (_, begin), end in zip(cuts, ends, strict=True)]


@dataclass
class Files(InputPartition):
    """Files of one day, for one task."""

    day: date
    paths: tuple[str, ...]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class MailReader(DataSourceReader):
    """Partitions by day, of FILES_A_TASK files at most. Comparisons of day with a date are applied here, before anything is listed."""

    def __init__(self, path: str, schema):
        self.path, self.columns, self.tests = path, [f.name for f in schema.fields], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        tests = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
        for f in filters:
            if getattr(f, "attribute", None) == ("day",) and type(f) in tests and isinstance(f.value, date):
                self.tests.append((tests[type(f)], f.value))
            elif not (isinstance(f, IsNotNull) and f.attribute == ("day",)):  # no folder is without a day
                yield f

    def _days(self) -> list[tuple[date, str]]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            m = re.fullmatch(r"day=(\d{4}-\d{2}-\d{2})", info.base_name)
            if m and info.type == fs.FileType.Directory:
                out.append((date.fromisoformat(m[1]), info.path))
        return sorted(out)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        out = []
        for day, folder in self._days():
            if all(getattr(day, test)(value) for test, value in self.tests):
                system, _ = _file_system(self.path)
                found = sorted(i.path for i in system.get_file_info(fs.FileSelector(folder, recursive=True)) if i.is_file and not i.base_name.startswith(("_", ".")))
                out += [Files(day, tuple(found[i : i + FILES_A_TASK])) for i in range(0, len(found), FILES_A_TASK)]
        return out or [Files(date.min, ())]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                content = f.read()
            one = path.endswith(".eml")
            for i, data in enumerate([content] if one else messages_of_mbox(content)):
                row = dict(zip(names, _message(path if one else f"{path}#{i:08d}", data), strict=True)) | {"day": partition.day}
                yield tuple(row[c] for c in self.columns)


class MailSource(DataSource):
    """format("halyard_mail"), option path: the messages of a mailbox by day."""

    @classmethod
    def name(cls) -> str:
        return "halyard_mail"

    def schema(self) -> str:
        return f"{SCHEMA}, day date"

    def reader(self, schema) -> MailReader:
        return MailReader(self.options["path"], schema)


def read_mailbox(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    """Messages of a mailbox by day with decoded headers, day and seq (which grows with day, then msg_id); only folders of `since` and later are opened.

    The folder must be one that pyarrow's file systems reach. Turns on the session's filter pushdown for
    Python data sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailSource)
    rows = spark.read.format("halyard_mail").option("path", path).load()
    if since is not None:
        rows = rows.filter(F.col("day") >= F.lit(since))
    rows = rows.withColumns({"sender": decode_header(F.col("sender")), "subject": decode_header(F.col("subject"))})
    return numbered(rows, "day")
