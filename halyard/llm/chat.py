"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and ordered by sequence number. Streamed deltas, edits
and regenerations are folded into final messages; each message is rendered as one marked turn. Turns
are rows with their offset in the conversation, so a conversation of any length needs no large row.

A turn is `<s>[TAG] text [/TAG]</s>\\n` with INST, OUT and SYS for user, assistant and system, and
ROLE=name for any other role. Control strings inside a text are escaped by one more backslash in front,
which reading takes away again. The loss mask covers the texts of assistants.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
CONTROL = r"</?s>|\[/?(?:INST|OUT|SYS|ROLE)[\]=]"
TAGS = {"user": "INST", "assistant": "OUT", "system": "SYS"}

_TURN = re.compile(r"<s>\[(INST|OUT|SYS|ROLE=([^\]]*))\] (.*?) \[/(?:INST|OUT|SYS|ROLE)\]</s>\n", re.DOTALL)
_ESCAPED = re.compile(r"(\\*)\\(" + CONTROL + ")")
_ROLES = {tag: role for role, tag in TAGS.items()}


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)(" + CONTROL + ")", r"\\$1$2")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the final messages of a log (conv_id, seq, kind, msg, role, text).

    kind is message (opens message number msg), delta (adds to its text), edit or regenerate (sets its
    text anew and withdraws every later message that was last opened before). The last role that a
    message was given holds. Ties in seq go by kind and text. Null texts and roles count as empty; a message
    that only has deltas begins empty; other kinds are ignored. Null conv_id is a conversation too.
    """
    kind = F.col("kind")
    sets, redone = kind.isin("message", "edit", "regenerate"), kind.isin("edit", "regenerate")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.when(kind == "delta", 1).otherwise(0).alias("is_delta"), F.coalesce("text", F.lit("")).alias("text"))))
    messages = (
        events.filter(kind.isin("message", "delta", "edit", "regenerate"))
        .groupBy("conv_id", "msg")
        .agg(
            F.coalesce(F.max(F.when(kind == "message", F.col("seq"))), F.min("seq")).alias("opened"),
            F.max(F.when(redone, F.col("seq"))).alias("redone"),
            F.max(F.when(sets, F.col("seq"))).alias("set_at"),
            F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).getField("role").alias("role"),
            parts.alias("parts"),
        )
        .withColumn("parts", F.filter("parts", lambda p: F.col("set_at").isNull() | (p["seq"] >= F.col("set_at"))))
    )
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    alive = F.coalesce(F.max("redone").over(before) <= F.col("opened"), F.lit(True))
    messages = messages.withColumn("alive", alive).filter("alive")
    return messages.select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def format_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, msg, formatted, offset, loss_start, loss_length): one rendered turn per message.

    offset is where the turn begins in the formatted conversation (code points), which is the turns in
    order of msg joined by nothing. loss_start and loss_length give the part of the conversation under
    the loss mask, null for other roles than assistant.
    """
    tag = F.lit("ROLE=")
    role = F.coalesce("role", F.lit(""))
    name = F.concat(tag, F.url_encode(role))
    for r, t in TAGS.items():
        name = F.when(role == r, t).otherwise(name)
    opening = F.concat(F.lit("<s>["), name, F.lit("] "))
    closing = F.concat(F.lit(" [/"), F.when(name.startswith("ROLE="), F.lit("ROLE")).otherwise(name), F.lit("]</s>\n"))
    inner = escaped(F.coalesce("text", F.lit("")))
    out = messages.select("conv_id", "msg", opening.alias("opening"), inner.alias("inner"), closing.alias("closing"), (role == "assistant").alias("loss"))
    out = out.withColumn("formatted", F.concat("opening", "inner", "closing"))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum(F.char_length("formatted")).over(before), F.lit(0)))
    start = F.when(F.col("loss"), F.col("offset") + F.char_length("opening"))
    return out.select("conv_id", "msg", "formatted", "offset", start.alias("loss_start"), F.when(F.col("loss"), F.char_length("inner").cast("long")).alias("loss_length"))


def read_back(formatted: str) -> tuple[list[tuple[str, str]], str]:
    """The (role, text) of each whole turn at the front of formatted, and what follows them."""
    turns, at = [], 0
    while m := _TURN.match(formatted, at):
        role = _ROLES[m[1]] if m[1] in _ROLES else unquote_plus(m[2])
        turns.append((role, unescaped(m[3])))
        at = m.end()
    return turns, formatted[at:]


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, msg): what reading each formatted conversation gives, a turn at a time."""
    rows: list[tuple] = []
    conv, state = None, None

    def new() -> dict:
        return {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "rest": ""}

    def close() -> None:
        if state["rest"]:
            raise ValueError("a formatted conversation does not read back")
        rows.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        cols = zip(*rows, strict=True) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    for b in batches:
        for c, formatted, start, length in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if state is None or c != conv:
                if state is not None:
                    close()
                conv, state = c, new()
            if start is not None:
                at = start - state["all"]  # the mask counts from the front of the conversation
                if not 0 <= at <= at + length <= len(formatted):
                    raise ValueError("a loss mask lies outside its turn")
                text = unescaped(formatted[at : at + length])
                state["chars"] += len(text)
                state["loss"].update(text.encode("utf-8", "surrogatepass"))
            state["all"] += len(formatted)
            turns, state["rest"] = read_back(state["rest"] + formatted)
            for role, text in turns:
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if len(rows) > 10_000:
            yield batch()
            rows = []
    if state is not None:
        close()
    yield batch()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation of format_messages(): counts and hashes of what its formatted text reads back to, and of what stands under its loss mask."""
    rows = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", "loss_start", "loss_length", "msg")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "msg").select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(_digest, DIGEST_SCHEMA)


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of a table (conv_id, turn, role, text), such that folding it gives the rows again.

    Each row opens a message with half of its text and streams the rest. Every third message begins as a
    draft, which an edit (a regeneration, if an assistant's) replaces; before every other of those the
    next message has been begun, which that withdraws. Rows are ordered by turn; rows that repeat a turn
    are separate messages, by role and text.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("msg", number)
    half = F.floor(F.char_length("text") / 2).cast("int")
    front, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text"))
    msg, role, none = F.col("msg"), F.col("role"), F.lit(None).cast("string")

    def event(step: int, kind: Column, of: Column, by: Column, text: Column) -> Column:
        return F.struct((msg * 5 + step).alias("seq"), kind.alias("kind"), of.alias("msg"), by.alias("role"), text.alias("text"))

    message, delta = F.lit("message"), F.lit("delta")
    plain = F.array(event(0, message, msg, role, front), event(1, delta, msg, none, rest))
    draft = [event(0, message, msg, role, F.lit("a draft")), event(1, delta, msg, none, F.concat(F.lit(" of "), "text"))]
    anew = [event(3, F.when(role == "assistant", "regenerate").otherwise("edit"), msg, none, front), event(4, delta, msg, none, rest)]
    early = event(2, message, msg + 1, none, F.lit("an answer to the draft"))
    log = F.when(msg % 6 == 0, F.array(*draft, early, *anew)).when(msg % 3 == 0, F.array(*draft, *anew)).otherwise(plain)
    return rows.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversation_digests(format_messages(fold_events(events_of_turns(turns.union(extra)))))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (
  SELECT *, length('<s>[' || CASE role WHEN 'user' THEN 'INST] ' WHEN 'assistant' THEN 'OUT] ' WHEN 'system' THEN 'SYS] ' ELSE 'ROLE=' || url_encode(role) || '] ' END
    || regexp_replace(text, '(\\\\*)(</?s>|\\[/?(?:INST|OUT|SYS|ROLE)[\\]=])', '\\\\\\1\\2', 'g')
    || CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN ' [/OUT]' WHEN 'system' THEN ' [/SYS]' ELSE ' [/ROLE]' END || '</s>' || chr(10)) AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
