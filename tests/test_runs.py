"""Runs that follow one another: versions, the parse cache, the log, the mail run."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from halyard.operators import parse
from halyard.plans import mail_run, state_loop
from halyard.plans import status_run as run
from halyard.sources.mail import Files, MailReader, MailSource, messages_of_mbox, read_mailbox
from halyard.sources.tables import REGISTRY
from halyard.sources.versions import Conflict, Store

DAY = date(2026, 8, 22)


def registry(spark, rows):
    names = [c.split()[0] for c in REGISTRY.replace("struct<type:string,detail:string,account:string>", "struct").replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REGISTRY)


def sources(spark, pages, rows=None, calendar=(), articles=(), federal_url=None):
    """pages: URL to html, or to an error that begins with `HTTP`."""
    keys = rows or [{"state": c, "state_code": c, "ingest_mode": m, "buildable": True, "flag_page_url": f"http://{c}/", "rss_url": f"http://{c}/", "toggle_hub_url": f"http://{c}/"} for c, m in (("A", "diff"), ("B", "feed"), ("C", "toggle"))]
    docs = spark.createDataFrame([(u, None if h.startswith("HTTP") else h, h if h.startswith("HTTP") else None) for u, h in pages.items()], "url string, html string, error string")
    cal = spark.createDataFrame(list(calendar), "ordinal int, id string, name string, date date, active boolean, scope string, reason string")
    return state_loop.Sources(
        registry(spark, keys), docs, spark.createDataFrame(list(articles), "url string, html string"), spark.createDataFrame([], mail_run.ORDERS), spark.createDataFrame([], mail_run.SEEN), cal, federal_url
    )


def feed(title, link="http://B/1"):
    return f"<item><title>{title}</title><link>{link}</link><pubDate>20 Aug 2026</pubDate></item>"


PAGES = {
    "http://A/": "<p>Flag status: half-staff at 10:01 AM. Updated on August 20, 2026</p>",
    "http://B/": feed("Governor Lee orders flags lowered to half-staff until sunset on August 22, 2026"),
    "http://C/": '<div class="flag-status"><a href="/flag-status-half.html">x</a></div>',
}


def records(version):
    return {r.state_code: r for r in version.table("records").collect()}


def go(store, src, batch, day=DAY, **more):
    return state_loop.advance(store, src, batch, day, datetime(day.year, day.month, day.day, 12), **({"least_covered": 1} | more))


def test_a_second_run_over_unchanged_pages_parses_none_and_moves_with_the_day(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = go(store, sources(spark, PAGES), "1")
    assert state_loop.parsed_count(first) == 3 and {c: r.status for c, r in records(first).items()} == {"A": "half", "B": "half", "C": "half"}
    second = go(store, sources(spark, PAGES), "2", date(2026, 8, 24))
    assert state_loop.parsed_count(second) == 0
    got = records(second)
    assert {c: r.status for c, r in got.items()} == {"A": "half", "B": "full", "C": "half"} and not any(r.changed for r in got.values())
    assert got["B"].last_expired_order.why == "window 2026-08-22..2026-08-22" and store.log(state_loop.LOG).count() == 0
    frozen = records(go(store, sources(spark, PAGES), "3", date(2027, 8, 22)))
    assert frozen["A"].coverage == "stale" and frozen["A"].status == "unknown" and "frozen" in frozen["A"].error


def test_a_clock_is_no_change_and_words_are(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    go(store, sources(spark, PAGES), "1")
    clock = PAGES | {"http://A/": PAGES["http://A/"].replace("10:01", "10:31")}
    second = go(store, sources(spark, clock), "2")
    assert state_loop.parsed_count(second) == 1 and not records(second)["A"].changed
    third = go(store, sources(spark, clock | {"http://A/": "<p>Flag status: full-staff. Updated on August 20, 2026</p>"}), "3")
    assert records(third)["A"].changed and records(third)["A"].order.status == "full"
    assert [tuple(r)[:3] for r in store.log(state_loop.LOG).select("key", "value", "version").collect()] == [("A", "full", 3)]


def test_a_failed_source_keeps_what_it_said(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    go(store, sources(spark, PAGES), "1")
    got = records(go(store, sources(spark, PAGES | {"http://B/": "HTTP 500", "http://C/": "HTTP 404"}), "2"))
    assert (got["B"].status, got["B"].coverage, got["B"].error, got["B"].order.title) == ("half", "stale", "HTTP 500", "Governor Lee orders flags lowered to half-staff until sunset on August 22, 2026")
    back = records(go(store, sources(spark, PAGES), "3"))
    assert back["C"].coverage == "covered" and not back["C"].changed  # what it says is what it said before it failed


def test_a_newer_parser_parses_again(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    go(store, sources(spark, PAGES), "1")
    monkeypatch.setattr(parse, "VERSION", parse.VERSION + 1)
    monkeypatch.setattr(parse.known_and_new, "__defaults__", (parse.VERSION,))
    assert state_loop.parsed_count(go(store, sources(spark, PAGES), "2")) == 3


def test_refused_runs_leave_the_last_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = go(store, sources(spark, PAGES), "1")
    with pytest.raises(ValueError, match="restricted"):
        go(store, sources(spark, PAGES), "2", only="A")
    with pytest.raises(Exception, match="too few covered"):
        go(store, sources(spark, PAGES), "2", least_covered=4)
    with pytest.raises(ValueError, match="does not come after"):
        go(store, sources(spark, PAGES), "0")
    assert store.latest().number == first.number == 1 and store.latest().table("records").count() == 3
    assert go(store, sources(spark, PAGES), "1").number == 1  # repeated: returned as it is


def test_the_federal_layer_is_state_and_is_told(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    calendar = [(0, "m", "Memorial Day", date(2026, 8, 23), True, "until-noon", "why")]
    page = {"http://wh/": f'<h2><a href="/p">President orders flags at half-staff from August 24, 2026 through August 26, 2026</a></h2>{" "}<h2><a href="/q">Flags lowered once</a></h2>'}
    src = lambda pages: sources(spark, pages, calendar=calendar, federal_url="http://wh/")
    one = go(store, src(PAGES), "1")
    assert one.table("federal").first().status is None and records(one)["A"].reason_source == "state"
    two = go(store, src(PAGES), "2", date(2026, 8, 23))
    fed = two.table("federal").first()
    assert (fed.reason, fed.authority, fed.changed) == ("Memorial Day", "statute", True) and {r.scope for r in records(two).values()} == {"until-noon"}
    three = go(store, src(PAGES | page), "3", date(2026, 8, 25))
    fed = three.table("federal").first()
    assert (fed.authority, fed.source_url, str(fed.end_date)) == ("presidential proclamation", "http://wh/p", "2026-08-26") and state_loop.parsed_count(three) == 1
    four = go(store, src(PAGES | page), "4", date(2026, 8, 26))
    assert state_loop.parsed_count(four) == 0 and not four.table("federal").first().changed
    go(store, src(PAGES | page), "5", date(2026, 8, 27))
    log = [(r.version, r.value) for r in store.log(state_loop.LOG).filter("key = 'US'").orderBy("version").collect()]
    assert log == [(2, "half"), (3, "half"), (5, "full")]
    doc = four.table("document").first().document
    assert '"authority":"presidential proclamation"' in doc and '"generated_at":"2026-08-26T12:00:00"' in doc


def test_a_killed_batch_is_repeated_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    go(store, sources(spark, PAGES), "1")
    changed = PAGES | {"http://C/": '<div class="flag-status"><b>now</b><a href="/flag-status-full.html">x</a></div>'}

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", die)  # all is written but the manifest
        with pytest.raises(KeyboardInterrupt):
            go(store, sources(spark, changed), "2")
    assert store.latest().number == 1 and store.log(state_loop.LOG).count() == 0 and records(store.latest())["C"].status == "half"
    for _ in range(2):
        go(store, sources(spark, changed), "2")
    assert [r.key for r in store.log(state_loop.LOG).collect()] == ["C"]
    store.vacuum()
    assert store.latest().table("records").count() == 3 and len(list((tmp_path / "data").iterdir())) == 2


def test_versions_conflict_and_retire(spark, tmp_path):
    store = Store(spark, str(tmp_path), keep_versions=2)
    assert store.latest() is None and store.log("key string").count() == 0
    a, b = store.begin("1"), store.begin("1")
    for d in (a, b):
        d.keep(spark.range(3), "t")
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    for i in range(2, 6):
        d = store.begin(str(i))
        d.keep(spark.range(i), "t")
        d.commit()
    assert store.at(3).table("t").count() == 3 and store.latest().table("none") is None
    store.vacuum()
    assert store._numbers() == [4, 5] and store.latest().table("t").count() == 5 and len(list((tmp_path / "data").iterdir())) == 2


def test_the_session_can_name_the_federal_page(spark):
    docs = spark.createDataFrame([("http://wh/", "x", None)], "url string, html string, error string")
    assert run.federal_page(docs) is None
    spark.conf.set(run.FEDERAL_URL, "http://wh/")
    try:
        assert run.federal_page(docs).count() == 1
    finally:
        spark.conf.unset(run.FEDERAL_URL)


# --- mail ---


def mailbox(folder, days):
    """days: day to messages (file, sender, subject)."""
    for day, found in days.items():
        (folder / f"day={day}").mkdir(parents=True)
        for name, sender, subject in found:
            text = f"From: {sender}\nSubject: {subject}\nDate: {date.fromisoformat(day):%d %b %Y} 10:00:00 +0000\n\nbody\n"
            (folder / f"day={day}" / name).write_text(text if name.endswith(".eml") else f"From x\n{text}From y\n{text}")
    return str(folder)


def test_days_outside_the_filter_are_not_opened(spark, tmp_path):
    path = mailbox(tmp_path, {"2026-08-01": [("a.eml", "a@x", "s")], "2026-08-10": [("b.eml", "b@x", "s"), ("c.mbox", "c@x", "t")], "2026-08-12": [("d.eml", "d@x", "s")]})
    (tmp_path / "day=2026-08-01" / "a.eml").chmod(0)
    (tmp_path / "day=2026-08-01" / "b.eml").symlink_to("/nowhere")  # fails if it is opened
    rows = read_mailbox(spark, path, date(2026, 8, 10))
    assert [(r.day.day, r.sender) for r in rows.orderBy("seq").collect()] == [(10, "b@x"), (10, "c@x"), (10, "c@x"), (12, "d@x")]
    assert read_mailbox(spark, path).filter("day = DATE'2026-08-12'").count() == 1 and read_mailbox(spark, path, date(2027, 1, 1)).count() == 0
    plan = read_mailbox(spark, path, date(2026, 8, 10))._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull(day" not in plan and "Filter (day" not in plan
    assert read_mailbox(spark, str(tmp_path / "none")).count() == 0


def test_partitions_are_of_one_day_and_bounded(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual, StringContains
    from pyspark.sql.types import StructType

    import halyard.sources.mail as mail

    monkeypatch.setattr(mail, "FILES_A_TASK", 2)
    path = mailbox(tmp_path, {f"2026-08-{d:02d}": [(f"{i}.eml", "a@x", "s") for i in range(5)] for d in (1, 2, 3)})
    reader = MailReader(path, StructType.fromDDL(MailSource({"path": path}).schema()))
    other = StringContains(("subject",), "s")
    assert list(reader.pushFilters([GreaterThan(("day",), date(2026, 8, 1)), LessThanOrEqual(("day",), date(2026, 8, 2)), other])) == [other]
    parts = reader.partitions()
    assert [(p.day.day, len(p.paths)) for p in parts] == [(2, 2), (2, 2), (2, 1)] and all(isinstance(p, Files) for p in parts)
    assert messages_of_mbox(b"") == [] and messages_of_mbox(b"no mbox") == []


def test_mail_state_survives_runs_without_mail_and_reaches_the_status_run(spark, tmp_path):
    box = mailbox(
        tmp_path / "box",
        {
            "2026-08-19": [("1.eml", "x@news.mi.example", "Governor Lee orders flags lowered to half-staff in Michigan"), ("2.eml", "y@else.example", "Flags lowered to half-staff")],
            "2026-08-21": [("3.eml", "Gov <g@oh.example>", "Flags lowered to half-staff until noon"), ("4.eml", "z@else.example", "Flags lowered to half-staff, again"), ("5.eml", "w@wyo.gov", "Flags lowered to half-staff")],
        },
    )
    channel = ("email", "https://m.example/accounts/MIGOV/new", None)
    reg = registry(
        spark,
        [
            {"state": "Michigan", "state_code": "MI", "ingest_mode": "email", "notification_channel": channel}, {"state": "Ohio", "state_code": "OH", "ingest_mode": "email", "expected_sender_domain": " OH.example "},
            {"state": "Utah", "state_code": "UT", "ingest_mode": "email"}, {"state": "Wyoming", "state_code": "WY", "ingest_mode": "feed"},
        ],
    )
    hints, accounts, names, allowed = mail_run.dimensions(reg)
    assert [tuple(r)[1:] for r in hints.orderBy("priority").collect()][-1] == ("oh.example", "OH") and hints.count() == len(mail_run.SENDER_HINTS) + 1
    assert [tuple(r)[1:] for r in accounts.collect()] == [("migov", "MI")] and names.count() == 4 and sorted(r.code for r in allowed.collect()) == ["MI", "OH", "UT"]
    store = Store(spark, str(tmp_path / "mail"))
    assert mail_run.advance(store, None, reg, "0") is None and mail_run.told_by_mail(store)[0].count() == 0
    first = mail_run.advance(store, read_mailbox(spark, box), reg, "1")
    assert mail_run.advance(store, None, reg, "2").number == first.number
    orders, seen = mail_run.told_by_mail(store)
    assert {r.state_code: (r.title, str(r.sent_date)) for r in orders.collect()} == {"MI": ("Governor Lee orders flags lowered to half-staff in Michigan", "2026-08-19"), "OH": ("Flags lowered to half-staff until noon", "2026-08-21")}
    assert [tuple(r) for r in first.table("unattributed").orderBy("sender_domain").collect()] == [("else.example", 2, ["Flags lowered to half-staff", "Flags lowered to half-staff, again"]), ("wyo.gov", 1, ["Flags lowered to half-staff"])]
    mail_run.advance(store, read_mailbox(spark, box, date(2026, 8, 20)), reg, "3")
    orders, seen = mail_run.told_by_mail(store)
    assert {r.state_code: str(r.seen_on) for r in seen.collect()} == {"MI": "2026-08-19", "OH": "2026-08-21"} and orders.count() == 1
    src = sources(spark, {"http://x/": "HTTP 404"}, reg.collect() and [r.asDict() for r in reg.collect()])
    src = state_loop.Sources(src.registry, src.documents, src.articles, orders, seen, src.calendar)
    got = records(go(Store(spark, str(tmp_path / "status")), src, "1"))
    assert {c: (r.status, r.coverage) for c, r in got.items()} == {"OH": ("half", "covered"), "MI": ("full", "covered"), "UT": ("unknown", "not_covered"), "WY": ("unknown", "not_covered")}
    assert got["OH"].scope == "until-noon" and got["MI"].source_url == "https://m.example/accounts/MIGOV/new" and got["UT"].error.startswith("subscription pending")


def test_unattributed_senders_keep_the_first_subjects_of_very_many(spark):
    from halyard.operators.attribution import unattributed

    rows = spark.range(200_000).select(F.col("id").alias("seq"), F.concat(F.lit("a@x"), (F.col("id") % 1).cast("string"), F.lit(".example")).alias("sender"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("subject"))
    out = unattributed(rows)
    assert [tuple(r) for r in out.collect()] == [("x0.example", 200_000, ["s0", "s1"])]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def two_runs(spark, tmp_path, monkeypatch):
    """A store after two runs over more keys than one document holds; in the second a page says something else."""
    from halyard.sources import tables

    monkeypatch.setattr(tables, "MOST_IN_DOCUMENT", 1)
    monkeypatch.setattr(tables, "IN_PART", 1, raising=False)
    store = Store(spark, str(tmp_path))
    go(store, sources(spark, PAGES), "1")
    go(store, sources(spark, PAGES | {"http://A/": "<p>Flag status: full-staff. Updated on August 20, 2026</p>"}), "2")
    return store


def test_runs_over_many_keys_are_committed_with_all_parts_of_the_document(two_runs):
    import json

    last = two_runs.latest()
    docs = [json.loads(r.document) for r in last.table("document").orderBy("first_code").collect()]
    assert last.number == 2 and [list(d["states"]) for d in docs] == [["A"], ["B"], ["C"]] and all(d["meta"]["covered"] == 3 for d in docs)
    assert {c: r.status for c, r in records(last).items()} == {"A": "full", "B": "half", "C": "half"} == {c: x["status"] for d in docs for c, x in d["states"].items()}


def test_the_log_of_runs_over_many_keys(two_runs):
    assert [tuple(r)[:3] for r in two_runs.log(state_loop.LOG).select("key", "value", "version").collect()] == [("A", "full", 2)]


def test_tables_of_all_keys_are_not_broadcast(spark):
    src = sources(spark, PAGES)
    pages = run.pages_of(src.registry, src.documents)
    known, lacking = parse.known_and_new(run.to_parse(pages), parse.parsed(run.to_parse(pages), "key").withColumn("version", F.lit(parse.VERSION)))
    items = run.listed_items(pages, known)
    wanted = run.wanted_articles(items, src.articles.union(spark.createDataFrame([("http://B/1", "x")], "url string, html string")))
    prior = spark.createDataFrame([("A", "half", None, "h", None, None)], state_loop.STATE)
    states = run.evaluate(src.registry, pages, known, run.candidates(items, parse.parsed(wanted, "url")), src.orders, src.seen, prior, F.lit(DAY))
    for df in (pages, known, lacking, items, wanted, states):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # rows without a parse are joined by values of their own, not all by null
    from halyard.operators.resolve import known_or_own

    rows = spark.range(100).select(known_or_own(F.when(F.col("id") < 10, "x"), F.col("id")).alias("by"))
    assert rows.distinct().count() == 91 and rows.filter("by IS NULL").count() == 0


def test_the_second_run_reads_no_html_for_pages_that_are_parsed_already(spark, tmp_path, monkeypatch):
    plans, listed = [], run.listed_items
    monkeypatch.setattr(run, "listed_items", lambda pages, parses: plans.append(parses._jdf.queryExecution().optimizedPlan().toString()) or listed(pages, parses))
    store = Store(spark, str(tmp_path))
    go(store, sources(spark, PAGES), "1")
    second = go(store, sources(spark, PAGES | {"http://A/": "<p>Flag status: full-staff. Updated on August 20, 2026</p>"}), "2")
    assert len(plans) == 2 and not any("html" in p for p in plans)
    assert state_loop.parsed_count(second) == 1 and {c: r.status for c, r in records(second).items()} == {"A": "full", "B": "half", "C": "half"}
