"""Fixture cases: input, expected value."""

import datetime

import pytest
from pyspark.sql import functions as F

from halyard.functions import dates, items, rules, text
from halyard.operators.coverage import covers


def values(spark, inputs, expr):
    """expr(column) of each input, in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_declared_status(spark):
    cases = [
        ("Flag Status: Full Staff", "full"),
        ("Flag Status Full Staff", "full"),
        ("Status: FULL STAFF", "full"),
        ("Current status: half-staff", "half"),
        ("Current status: half", "half"),
        ("National Flag: Half Staff  State Flag: Half Staff", "half"),
        ("United States Flag: Full-Staff Allegheny County Only United States Flags: Half-Staff", "full"),
        ("Michigan Flag Honor status notification including text, Full Staff", "full"),
        ("the flag of the state of Utah are currently at Half Staff", "half"),
        ("Flags are at full staff.", "full"),
        ("Governor Healey has ordered that the flags be lowered to half-staff at all state buildings", "half"),
        ("United States flag to be flown at half staff", "half"),
        ("Flags at Full-Staff", "full"),
        ("Newsroom Flags at Half-Staff", "unknown"),
        ("the flag may be flown at half-staff by presidential order", "unknown"),
        ("", "unknown"),
        (None, "unknown"),
        ("policy: flags at half-staff. " + "x" * 80 + " Flags at half-staff", "half"),
    ]
    got = values(spark, [a for a, _ in cases], rules.current_status)
    assert [g.value for g in got] == [b for _, b in cases]
    assert got[15].evidence is None and got[0].evidence == "declaration: 'Flag Status: Full Staff'"


def test_status_and_authority(spark):
    got = values(spark, ["there is no current half-staff order", "lowered to half-staff, then returned to full staff", "Gov. X Lowers Flags to Honor Y", "half staff", "", None], rules.classify_status)
    assert [g.value for g in got] == ["full", "unknown", "half", "half", "unknown", "unknown"]
    assert got[0].evidence == "negation: 'no current half-staff'" and got[2].evidence == "Lowers Flags" and got[4].evidence is None
    got = values(spark, ["authority vested in me by the Constitution and the laws of the United States", "Governor Cox orders flags lowered by order of the President", "Gov. Cox orders flags", ""], rules.classify_authority)
    assert [g.value for g in got] == ["president", "governor", "governor", "unknown"]
    assert got[1].evidence.startswith("governor acted, referencing federal: ")


def test_text(spark):
    assert values(spark, ["a<script>x</script>b &amp;lt; c", None, "<![CDATA[x &nbsp; y]]>\n z", "a &copy;"], text.strip_html) == ["a b < c", "", "x y z", "a &copy;"]
    a, b, c = values(spark, ["Flag status at 10:30 AM 123456789", "Flag  <b>status</b> at 9:15 PM 987654321", "Flag status at half"], text.status_fingerprint)
    assert a == b != c
    assert values(spark, ["SPANISH: x", "Traducción: y", "Spanish order"], text.is_translation) == [True, True, False]
    got = values(spark, ["Flags at Half-Staff at State Capitol in Honor of X", "Flags at Half-Staff in Honor of X"], text.order_scope)
    assert [(g.scope, g.evidence) for g in got] == [("limited", "at State Capitol"), ("statewide", None)]
    assert values(spark, ["half-staff until noon", "until sunset"], text.until_noon) == [True, False]
    assert values(spark, ["One. Two! Three? Four."], text.first_sentences) == ["One. Two! Three?"]
    assert values(spark, ["=?utf-8?q?caf=C3=A9?=", None, "plain"], text.decode_header) == ["café", "", "plain"]


def test_dates(spark):
    d = datetime.date
    cases = {
        "2026-08-03T10:00:00Z": d(2026, 8, 3), "Aug 3, 2026": d(2026, 8, 3), "3 Aug 2026": d(2026, 8, 3), "8/3/2026": d(2026, 8, 3), "Sept. 5, 2026": None, "2026-13-45": None,
        "1999-05-01": None, "8/3/2026 or 2026-01-02": d(2026, 1, 2), "Tue, 3 Aug 2026 10:00 GMT": d(2026, 8, 3), "": None, None: None,
    }
    assert values(spark, list(cases), dates.parse_any_date) == list(cases.values())
    got = values(spark, ["until sunset on August 18, 2026", "from August 14, 2026 through August 18, 2026.", "nothing", None], dates.date_range)
    assert [(g.start_date, g.end_date) for g in got] == [(d(2026, 8, 18), d(2026, 8, 18)), (d(2026, 8, 14), d(2026, 8, 18)), (None, None), (None, None)]
    got = values(spark, ["From: Sunrise Sunday, July 12, 2026 Until: Sunset Saturday, July 18, 2026"], dates.advertised_window)
    assert (got[0].start_date, got[0].end_date) == (d(2026, 7, 12), d(2026, 7, 18))
    got = values(spark, ['<meta name="DCTERMS.modified" content="2026-01-02">', "<p>updated on May 3, 2026</p>", "<p>1/2/2026 and 3/4/2026</p>", "<p>Aug. 15</p>", "<p>Dec. 1</p>", None], lambda c: dates.page_last_modified(c, F.lit("2026-08-22").cast("date")))
    assert got == [d(2026, 1, 2), d(2026, 5, 3), d(2026, 3, 4), d(2026, 8, 15), d(2025, 12, 1), None]
    assert values(spark, ["Tue, 18 Aug 2026 23:30:00 -0400", "x", None], dates.mail_date) == [d(2026, 8, 18), None, None]


@pytest.mark.parametrize(
    ("start", "end", "day", "verdict"),
    [
        ("2026-07-12", "2026-07-18", "2026-07-18", True), ("2026-07-12", "2026-07-18", "2026-08-15", False), (None, "2026-08-20", "2026-08-20", True), ("2026-08-22", None, "2026-08-22", True),
        ("2026-08-23", None, "2026-08-22", False), ("2026-08-20", None, "2026-08-22", True), ("2026-08-19", None, "2026-08-22", False), (None, None, "2026-08-22", None),
    ],
)
def test_covers(spark, start, end, day, verdict):
    d = [F.lit(x).cast("date") for x in (start, end, day)]
    got = spark.range(1).select(covers(*d).alias("c")).first().c
    assert got.verdict is verdict and got.why


def test_dedupe_keeps_first_and_third(spark):
    df = spark.sql("SELECT array(named_struct('url','u1','title','t1'), named_struct('url','u1','title','t2'), named_struct('url','u2','title','T2'), named_struct('url','u3','title','SPANISH: x')) AS items")
    assert [x.url for x in df.select(items.dedupe_in_order(F.col("items")).alias("k")).first().k] == ["u1", "u2"]


def test_toggle_and_counties(spark):
    both = '<a href="x/flag-status-half.html"></a><!-- flag_status_full -->'
    got = values(spark, [both, '<div class="a flag-status"><a href="/flag-status-full">x</a> Flag Status: Full-Staff</div>', None], rules.toggle_status)
    assert [g.value for g in got] == ["unknown", "full", "unknown"]
    assert got[1].evidence.startswith("flag-status widget") or got[1].value == "full"
    got = values(spark, ["United States Flag: Full-Staff Allegheny County Only United States Flags: Half-Staff"], rules.county_exceptions)
    assert [(c.county, c.status) for c in got[0]] == [("Allegheny", "half")]
