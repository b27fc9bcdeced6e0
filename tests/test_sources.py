import json

from pyspark.sql import functions as F

from halyard.operators import parse, resolve
from halyard.sources import tables
from halyard.streaming.changes import changes_stream, publish


def test_json_sources(spark, tmp_path):
    assert tables.read_json_array(spark, str(tmp_path / "none.json"), tables.REGISTRY).count() == 0
    (tmp_path / "bad.json").write_text("{[")
    assert tables.read_json_array(spark, str(tmp_path / "bad.json"), tables.REGISTRY).count() == 0
    (tmp_path / "r.json").write_text(json.dumps([{"state_code": "MI", "ingest_mode": "email"}, {"state_code": "OH", "extra": 1}]))
    assert sorted(r.state_code for r in tables.read_json_array(spark, str(tmp_path / "r.json"), tables.REGISTRY).collect()) == ["MI", "OH"]
    (tmp_path / "c.json").write_text(json.dumps({"_parser_version": "8", "AL": {"hash": "a"}, "AK": {"hash": "b"}}))
    assert sorted(map(tuple, tables.read_keyed_json(spark, str(tmp_path / "c.json"), "hash string").collect())) == [("AK", "b"), ("AL", "a")]
    (tmp_path / "cal.json").write_text(json.dumps({"years": {"2026": [{"id": "m", "date": "2026-05-25", "active": True, "scope": "until-noon", "reason": "r"}], "2027": [{"id": "n", "date": "2027-05-15", "active": False}]}}))
    cal = tables.read_calendar(spark, str(tmp_path / "cal.json"))
    assert resolve.statutory_observance(cal, F.lit("2026-05-25").cast("date")).first().scope == "until-noon"
    assert resolve.statutory_observance(cal, F.lit("2027-05-15").cast("date")).count() == 0


def test_documents_and_gate(spark):
    landed = spark.createDataFrame([("https://a.org/x", 200, "hello", None), ("https://b.org/y", 200, "no", None), ("https://c.org/", 404, "", None), ("", None, None, None)], "url string, status int, body string, error string")
    policy = spark.createDataFrame([("https://b.org", False)], "site string, allowed boolean")
    got = {r.url: (r.html, r.error) for r in tables.documents(landed, policy).collect()}
    assert got == {"https://a.org/x": ("hello", None), "https://b.org/y": (None, "blocked by robots.txt"), "https://c.org/": (None, "HTTP 404"), "": (None, "no url")}
    rows = spark.range(3).select(F.lit("covered").alias("coverage"))
    assert resolve.publishable(rows, 3).count() == 3
    try:
        resolve.publishable(rows, 4).collect()
        raise RuntimeError("the gate let it pass")
    except Exception as e:
        assert "too few covered" in str(e)


def test_gate_leaves_rows_where_they_are(spark):
    rows = spark.range(0, 1000, 1, 4).select("id", F.lit("covered").alias("coverage"))
    gated = resolve.publishable(rows, 1000)
    assert gated.columns == rows.columns and gated.count() == 1000 and gated.rdd.getNumPartitions() == 4


def test_snapshot_document(spark):
    states = spark.createDataFrame([("OH", "full"), ("MI", "half")], "state_code string, status string")
    counts = resolve.coverage_counts(spark.createDataFrame([("covered", None), ("stale", "x")], "coverage string, error string"))
    doc = json.loads(tables.status_document(states, counts, "2026-08-22").first().document)
    assert doc["states"]["MI"]["status"] == "half" and doc["meta"]["stale"] == 1 and list(doc["states"]) == ["MI", "OH"]
    try:
        tables.MOST_IN_DOCUMENT, most = 1, tables.MOST_IN_DOCUMENT
        tables.status_document(states, counts, "2026-08-22").collect()
        raise RuntimeError("more states than the bound went into a document")
    except Exception as e:
        assert "more than 1 rows" in str(e)
    finally:
        tables.MOST_IN_DOCUMENT = most


def test_status_pages(spark):
    pages = spark.createDataFrame(
        [("a", '<meta name="last-modified" content="2026-08-20">Flag status: half-staff', False), ("b", '<meta name="last-modified" content="2025-01-02">Flag status: half-staff', False), ("c", "Flag status: half staff From: July 12, 2026 Until: July 18, 2026", False), ("d", "Flag status: half staff as of 8/20/2026", True)],
        "k string, html string, signature_check_required boolean",
    )
    got = {r.k: (r.status, r.coverage) for r in resolve.status_pages(pages, F.lit("2026-08-22").cast("date")).collect()}
    assert got == {"a": ("half", "covered"), "b": ("unknown", "stale"), "c": ("full", "covered"), "d": ("unknown", "covered")}


def test_mail_is_numbered_by_day_and_path(spark, tmp_path):
    from halyard.operators.messages import channels_seen, latest_orders
    from halyard.sources.mail import read_messages

    sent = {"b": "Tue, 18 Aug 2026 09:00:00 -0400", "a": "Tue, 18 Aug 2026 23:00:00 -0400", "c": "Mon, 17 Aug 2026 09:00:00 -0400", "z": None, "d": "Wed, 19 Aug 2026 09:00:00 -0400"}
    for name, date in sent.items():
        (tmp_path / f"{name}.eml").write_text(f"From: x@y.gov\nSubject: s\n{'Date: ' + date if date else 'X-No: date'}\n\nbody\n")
    rows = read_messages(spark, str(tmp_path))
    assert [r.msg_id[-5:-4] for r in rows.orderBy("seq").collect()] == ["z", "c", "a", "b", "d"]
    days = F.when(F.col("msg_id").rlike("[ab].eml"), "2026-08-18").when(F.col("msg_id").rlike("c.eml"), "2026-08-17")
    parsed = rows.select("msg_id", "seq", F.lit(None).cast("string").alias("reason"), F.lit("MI").alias("state_code"), days.alias("sent_date"))
    assert latest_orders(parsed).first().msg_id.endswith("/a.eml")  # the first of the last day
    assert channels_seen(parsed, spark.createDataFrame([], "state_code string, seen_on string")).first().seen_on == "2026-08-18"


def test_stream_matches_table_and_survives_restart(spark, tmp_path):
    src, log, ck = (str(tmp_path / x) for x in ("in", "log", "ck"))
    schema = "key string, seq long, content string"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], schema).coalesce(1).write.mode("append").parquet(src)
    publish(changes_stream(spark.readStream.schema(schema).parquet(src)), log, ck).awaitTermination()
    spark.createDataFrame([("a", 3, "y"), ("b", 2, "z")], schema).coalesce(1).write.mode("append").parquet(src)
    publish(changes_stream(spark.readStream.schema(schema).parquet(src)), log, ck).awaitTermination()
    got = sorted((r.key, r.seq, r.content) for r in spark.read.schema("key string, seq long, content string").json(f"{log}/batch=*").collect())
    assert got == [("a", 2, "y"), ("b", 2, "z")]


def test_mail_folder(spark, tmp_path):
    from halyard.operators.messages import choose_body
    from halyard.sources.mail import read_messages

    (tmp_path / "a.eml").write_bytes(b"From: =?utf-8?q?Caf=C3=A9?= <x@mi.gov>\r\nSubject: Flags\r\nDate: Tue, 18 Aug 2026 10:00:00 -0400\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nshort\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>a longer body</p>\r\n--b--\r\n")
    (tmp_path / "b.eml").write_bytes(b"From: y@z\r\nDate: Tue, 4 Aug 2026 10:00:00 +0000\r\nList-Id: KSOG.list\r\n\r\nplain & simple")
    (tmp_path / "c.eml").write_bytes(b"not a message")
    rows = {r.msg_id[-5:]: r for r in read_messages(spark, str(tmp_path)).withColumn("body", choose_body(F.col("parts"))).collect()}
    assert rows["a.eml"].sender == "Café <x@mi.gov>" and rows["a.eml"].body == "a longer body"
    assert rows["b.eml"].body == "plain & simple" and "KSOG.list" in rows["b.eml"].headers and rows["b.eml"].subject == ""
    assert read_messages(spark, str(tmp_path), F.lit("2026-08-10").cast("date")).count() == 2


def test_federal(spark):
    from halyard.plans.status_run import federal

    day = F.lit("2026-08-22").cast("date")
    cal = spark.createDataFrame([(0, "x", "2026-01-01", True, "full-day", "r")], "ordinal int, id string, date string, active boolean, scope string, reason string").withColumn("date", F.to_date("date"))
    titles = ("Flags at half-staff through July 1, 2026", "Flags at half-staff from August 20, 2026 through August 23, 2026", "Flags at full staff")
    html = "".join(f'<h2><a href="/{i}">{t}</a></h2>' for i, t in enumerate(titles))
    page = parse.parsed(spark.createDataFrame([(parse.PROCLAMATION, "http://wh/", False, html)], "kind string, url string, dedupe boolean, html string"))
    found = federal(cal, page, day).first()
    assert (found.reason, found.authority, found.scope) == (titles[1], "presidential proclamation", "full-day")
    feed = parse.parsed(spark.createDataFrame([(parse.PROCLAMATION, "http://wh/", False, f"<item><title>{titles[1]}</title></item>")], "kind string, url string, dedupe boolean, html string"))
    assert federal(cal, feed, day).first().reason == titles[1]
    assert federal(cal, None, day).count() == 0


def test_document_of_many_states_is_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tables, "IN_PART", 10)
    codes = [f"{i:03d}" for i in range(95)]
    states = spark.createDataFrame([(c, "half" if int(c) % 3 == 0 else "full") for c in codes], "state_code string, status string").repartition(5)
    counts = states.agg(F.count("*").alias("total"))
    federal = spark.createDataFrame([("half", "a day")], "status string, reason string")
    rows = sorted(tables.document_parts(states, 95, counts, "2026-08-22", federal).collect())
    docs = [json.loads(r.document) for r in rows]
    assert [c for d in docs for c in d["states"]] == codes and all(0 < r.n_states == len(d["states"]) <= 10 for r, d in zip(rows, docs, strict=True))
    assert all(d["states"][c]["status"] == ("half" if int(c) % 3 == 0 else "full") for d in docs for c in d["states"])
    assert all(d["meta"] == {"total": 95} and d["federal"]["reason"] == "a day" and d["part"] == {"first": r.first_code, "last": r.last_code} == {"first": min(d["states"]), "last": max(d["states"])} for r, d in zip(rows, docs, strict=True))
    one = tables.document_parts(states.filter("state_code < '005'"), 5, counts, "2026-08-22").collect()
    assert len(one) == 1 and list(json.loads(one[0].document)["states"]) == codes[:5] and "part" not in json.loads(one[0].document)
    none = tables.document_parts(states.limit(0), 0, counts, "2026-08-22").first()
    assert none.n_states == 0 and json.loads(none.document)["states"] == {}


def test_a_run_publishes_more_states_than_one_document_holds(spark, monkeypatch):
    from halyard.plans.queries import QUERIES
    from places import DATA

    monkeypatch.setattr(tables, "MOST_IN_DOCUMENT", 100)
    monkeypatch.setattr(tables, "IN_PART", 40, raising=False)
    got = QUERIES["status_document"](spark, f"{DATA}/sf0.001").first()
    n = spark.read.parquet(f"{DATA}/sf0.001/customer.parquet").count()
    assert n > 100 and got.n_states == n and got.first_code == "0" and got.date == "2026-08-22"
