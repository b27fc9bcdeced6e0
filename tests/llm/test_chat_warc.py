import datetime
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.llm import chat, warc

EVENTS = "conv_id long, seq long, kind string, msg long, role string, text string"


def test_fold(spark):
    log = [
        (1, 1, "message", 1, "user", "hel"), (1, 2, "delta", 1, None, "lo"), (1, 3, "message", 2, "assistant", ""), (1, 4, "delta", 2, None, "bad"), (1, 5, "regenerate", 2, None, ""), (1, 6, "delta", 2, None, "good"),
        (2, 1, "message", 1, "user", "old"), (2, 2, "message", 2, "assistant", "answer"), (2, 3, "edit", 1, None, "new"), (2, 4, "message", 3, "assistant", "later"),
        (4, 1, "message", 1, "user", "q"), (4, 2, "message", 2, "assistant", "old"), (4, 3, "edit", 1, None, "q2"), (4, 4, "message", 2, "assistant", "again"),
        (3, 1, "delta", 1, None, "orphan"), (3, 2, "ping", 1, None, "x"), (None, 1, "message", 1, None, None),
    ]
    got = chat.fold_events(spark.createDataFrame(log, EVENTS).repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 1, "user", "hello"), (1, 2, "assistant", "good"), (2, 1, "user", "new"), (2, 3, "assistant", "later"), (4, 1, "user", "q2"), (4, 2, "assistant", "again"), (3, 1, "", "orphan"), (None, 1, "", "")]))


def test_log_of_turns_has_edits_and_folds_to_the_turns(spark):
    turns = [(c, t, ("user", "assistant", None, "system")[(c + t) % 4], [None, "", "one", "two words", "long " * 40_000][(c * t) % 5], "x", 0) for c in range(6) for t in range(3 + 2 * c)]
    turns += [(1, 0, "user", "again", "x", 0), (1, 0, "user", "again", "x", 0), (None, 0, "user", "none", "x", 0)]  # a turn that repeats, and no identifier
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string, msg int").repartition(3)
    log = chat.events_of_turns(rows)
    kinds = {(r.kind, r["count"] > 0) for r in log.groupBy("kind").count().collect()}
    assert kinds == {(k, True) for k in ("message", "delta", "edit", "regenerate")}
    assert log.filter("text = 'an answer to the draft'").count() > 3
    want = {}
    for c, t, role, text, *_ in sorted(turns, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {}
    for r in chat.fold_events(log).orderBy("msg").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == want
    digests = {r.conv_id: r.turns_sha256 for r in chat.conversation_digests(chat.format_messages(chat.fold_events(log))).collect()}
    assert digests == {c: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in v).encode()).hexdigest() for c, v in want.items()}


def test_format_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\</s>", "a\\", "[ROLE=x] \\\\[/OUT]", "", None, "ends with [/OUT]</s>\n", "😀 <s><s>"]
    rows = [(1, i, role, t) for i, (t, role) in enumerate(zip(texts, ["user", "assistant", "tool box]", None, "system", "assistant", "user", "assistant"], strict=True))]
    formatted = chat.format_messages(spark.createDataFrame(rows, "conv_id long, msg long, role string, text string")).orderBy("msg").collect()
    whole = "".join(r.formatted for r in formatted)
    turns, rest = chat.read_back(whole)
    assert rest == "" and turns == [(r[2] or "", r[3] or "") for r in rows]
    assert "".join(chat.unescaped(whole[r.loss_start : r.loss_start + r.loss_length]) for r in formatted if r.loss_start is not None) == "".join(t or "" for t, r in zip(texts, rows, strict=True) if r[2] == "assistant")
    assert chat.conversation_digests(chat.format_messages(spark.createDataFrame([], "conv_id long, msg long, role string, text string"))).count() == 0


def test_loss_is_what_stands_under_the_mask(spark):
    import pytest

    rows = [(1, 1, "user", "a question"), (1, 2, "assistant", "one </s> two"), (1, 3, "assistant", ""), (1, 4, "assistant", None), (2, 1, "assistant", "ünï😀")]
    formatted = chat.format_messages(spark.createDataFrame(rows, "conv_id long, msg long, role string, text string"))
    told = lambda f: {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(f).collect()}
    good = told(formatted)
    assert good == {1: (12, hashlib.sha256(b"one </s> two").hexdigest()), 2: (4, hashlib.sha256("ünï😀".encode()).hexdigest())}
    for shifted in (formatted.withColumn("loss_start", F.col("loss_start") + 1), formatted.withColumn("loss_length", F.col("loss_length") + 1), formatted.withColumn("loss_start", F.lit(None).cast("long"))):
        assert told(shifted)[1] != good[1] and told(shifted)[2] != good[2]
    with pytest.raises(Exception, match="outside its turn"):
        told(formatted.withColumn("loss_start", F.col("loss_start") - 40))
    plan = chat.conversation_digests(formatted)._jdf.queryExecution().optimizedPlan().toString()
    assert "loss_start" in plan and "loss_length" in plan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE=", "]", "[", "<", " ", "x", "\n"]), max_size=12))
def test_escape_is_reversible(parts):
    import re

    t = "".join(parts)
    e = re.sub(r"(\\*)(" + chat.CONTROL + ")", r"\\\1\2", t)
    assert chat.unescaped(e) == t
    assert not re.search(r"(?<!\\)(?:" + chat.CONTROL + ")", e)


@pytest.mark.parametrize("seconds", [3600, 25, 1])  # of days, of minutes within one day, of one minute
def test_revisits_against_plain_loop(spark, seconds):
    rng = random.Random(seconds)
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=h * seconds)
    rows = []
    for i in range(300):
        url = rng.choice(["http://www.A.org/x/", "https://a.org:443/x#f", "a.org/x?utm_source=q", "http://b.org/?b=2&a=1", "http://b.org?a=1&b=2", None])
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        rows.append((i, url, rng.choice([at(rng.randrange(60)), at(rng.randrange(60)), None]), kind, rng.choice(['"e1"', 'W/"e1"', '"e2"', None]), rng.choice(["m1", "m2", None]), rng.choice([None, {"X": str(i), "ETag": "t"}])))
    rows += rows[:20]
    records = spark.createDataFrame(rows, "record_id long, url string, date timestamp, kind string, etag string, last_modified string, headers map<string,string>").repartition(4)
    key = {None: None, "http://b.org/?b=2&a=1": "b.org?a=1&b=2", "http://b.org?a=1&b=2": "b.org?a=1&b=2"}
    want = []
    for i, url, date, kind, etag, modified, _ in rows:
        if kind != "revisit":
            continue
        k = key.get(url, "a.org/x")
        full = [r for r in rows if r[3] == "response" and key.get(r[1], "a.org/x") == k and r[1] and r[2] and date and r[2] < date]
        if not full or k is None:
            want.append((i, None, "no_earlier_response"))
            continue
        r = max(full, key=lambda r: (r[2], r[0]))
        bare = lambda t: t.removeprefix("W/") if t else t
        good = bare(etag) == bare(r[4]) if etag else modified == r[5] if modified else True
        want.append((i, r[0] if good else None, "resolved" if good else "validator_mismatch"))
    got = warc.resolve_revisits(records)
    assert sorted(map(repr, want)) == sorted(repr((r.record_id, r.refers_to, r.outcome)) for r in got.collect())
    body = records.withColumn("body", F.col("record_id").cast("string"))
    assert warc.with_payload(got.filter("outcome = 'resolved'"), body, "body").filter("body <> refers_to").count() == 0
    assert warc.resolve_revisits(records.limit(0)).count() == 0
    more = records.select("*", F.lit(1).alias("url_key"), F.lit("x").alias("outcome"), F.lit(2).alias("day"), F.lit(3).alias("minute"))
    assert sorted(map(repr, warc.resolve_revisits(more).collect())) == sorted(map(repr, got.collect()))


def test_very_long_urls_and_headers(spark):
    at, url, value = datetime.datetime(2024, 1, 1), "http://a.org/" + "x" * 300_000, "v" * 300_000
    rows = [(1, url, at, "response", '"e"', None, {"X": value}), (2, url + "/#top", at + datetime.timedelta(days=1), "revisit", '"e"', None, None), (3, "", at, "revisit", None, None, {}), (4, None, None, "revisit", None, None, None)]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, date timestamp, kind string, etag string, last_modified string, headers map<string,string>")).collect()}
    assert got[2].refers_to == 1 and got[2].headers == {"x": value} and {got[3].outcome, got[4].outcome} == {"no_earlier_response"} and got[4].headers == {}


def test_headers_merge(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "http://a/", at, "response", '"e"', None, {"Content-Type": "text/html", "ETag": "e", "Date": "1"}), (2, "http://a", at + datetime.timedelta(days=9), "revisit", '"e"', None, {"date": "2", "Content-Type": "bad", "Vary": "*"})]
    got = warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, date timestamp, kind string, etag string, last_modified string, headers map<string,string>")).first()
    assert got.headers == {"content-type": "text/html", "etag": "e", "date": "2", "vary": "*"} and got.refers_to == 1
