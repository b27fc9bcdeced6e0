"""One query per operator over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import dates, items, rules, text
from halyard.operators import attribution, coverage, history, messages, parse, patch, resolve, state
from halyard.plans.generated import case_sql, choose, long_date, orders
from halyard.sources.tables import documents as landed_documents
from halyard.sources.tables import notices
from halyard.streaming import changes, landing, resolution

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(value: str):
    return F.lit(value).cast("date")


# --- text -----------------------------------------------------------------------------------------

_ENTITY_SQL = "x"
for _entity, _char in text.ENTITIES:
    _ENTITY_SQL = f"replace({_ENTITY_SQL}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
STRIP_SQL = f"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<script\\b.*?</script>', ' ', 'gis'), '<style\\b.*?</style>', ' ', 'gis') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'gs'), '<[^>]+>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, trim(regexp_replace({_ENTITY_SQL}, '\\s+', ' ', 'g')) AS txt FROM b)
"""


@query(STRIP_SQL + "SELECT page_id, txt FROM c")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("txt"))


@query(STRIP_SQL + "SELECT page_id, sha256(txt)[1:16] AS hash FROM c")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.content_hash(F.col("html")).alias("hash"))


@query(STRIP_SQL + "SELECT page_id, sha256(regexp_replace(regexp_replace(txt, '(?i)\\b\\d{1,2}:\\d{2}(:\\d{2})?\\s*(?:AM|PM)?\\b', '', 'g'), '\\b\\d{9,}\\b', '', 'g'))[1:16] AS fingerprint FROM c")
def status_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.status_fingerprint(F.col("html")).alias("fingerprint"))


@query(f"SELECT o_orderkey, {case_sql('o_orderkey', ('limited', 'statewide', 'limited', 'limited', 'statewide'))} AS scope, {case_sql('o_orderkey', ('at State Capitol', None, 'Capitol building only', 'in Kent County only', None))} AS evidence, o_orderkey % 2 = 0 AS noon FROM orders")
def order_scope(spark, sf_dir):
    options = ("Flags at half-staff at State Capitol in honor of X", "Flags at half-staff in honor of X", "Half-staff, <b>Capitol building only</b>", "Lowered in Kent County only", "The capitol hosts a ceremony")
    t = F.concat(choose(F.col("o_orderkey"), options), choose(F.col("o_orderkey"), (" until noon", " until sunset")))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", text.order_scope(F.col("t")).alias("s"), text.until_noon(F.col("t")).alias("noon")).select("o_orderkey", "s.scope", "s.evidence", "noon")


@query("SELECT doc_id, array_to_string(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:3], ' ')[1:700] AS opening FROM documents")
def first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentences(F.col("text")).alias("opening"))


@query("SELECT c_custkey, lower(trim(replace('mail' || c_custkey || '.example.com', '>', ''))) AS domain, CASE WHEN c_custkey % 3 = 0 THEN 'https://h.example.org/a/' || c_custkey WHEN c_custkey % 3 = 1 THEN 'https://other.example.org/' || c_custkey ELSE 'https://h.example.org/p/q' END AS url FROM customer")
def addresses(spark, sf_dir):
    k = F.col("c_custkey")
    href = F.when(k % 3 == 0, F.concat(F.lit("../a/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("https://other.example.org/"), k.cast("string"))).otherwise("")
    sender = F.concat(F.lit("Office <News@Mail"), k.cast("string"), F.lit(".Example.com> "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.sender_domain(sender).alias("domain"), text.absolute_url(href, F.lit("https://h.example.org/p/q")).alias("url"))


# --- dates ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 5 AND year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders")
def parse_dates(spark, sf_dir):
    d = F.col("day")
    formats = (d.cast("string"), long_date(d), F.date_format(d, "d MMM. yyyy"), F.date_format(d, "M/d/yyyy"), F.concat(F.lit("2000-13-45 or "), long_date(d)), F.concat(F.lit("Sept. "), F.date_format(d, "d, yyyy")))
    return orders(spark, sf_dir).select("o_orderkey", dates.parse_any_date(F.concat(F.lit("Posted "), choose(F.col("o_orderkey"), formats), F.lit(" by us"))).cast("string").alias("parsed"))


@query(
    """WITH d AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 5 AS b FROM orders)
SELECT o_orderkey, strftime(CASE WHEN k = 1 THEN CASE WHEN year(b) >= 2000 THEN b END WHEN k = 0 THEN CASE WHEN year(a) >= 2000 THEN a END ELSE CASE WHEN year(a) >= 2000 THEN a END END, '%Y-%m-%d') AS start_date,
  strftime(CASE WHEN k IN (0, 1) AND year(b) >= 2000 THEN b END, '%Y-%m-%d') AS end_date FROM d"""
)
def date_range(spark, sf_dir):
    a, b = long_date(F.col("day")), long_date(F.date_add("day", 5))
    t = choose(F.col("o_orderkey"), (F.concat(F.lit("flags from "), a, F.lit(" through "), b, F.lit(". Thanks")), F.concat(F.lit("lowered until sunset on "), b), F.concat(F.lit("an order of "), a), F.concat(F.lit("issued "), a, F.lit(" until further notice"))))
    out = orders(spark, sf_dir).select("o_orderkey", dates.date_range(t).alias("r"))
    return out.select("o_orderkey", F.col("r.start_date").cast("string").alias("start_date"), F.col("r.end_date").cast("string").alias("end_date"))


# without a year that counts, a date is of 2001, or of 2000 if that would be over a month ahead of 2001-08-01
@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS d, try_cast('2001' || strftime(o_orderdate, '-%m-%d') AS DATE) AS a, try_cast('2000' || strftime(o_orderdate, '-%m-%d') AS DATE) AS b FROM orders),
y AS (SELECT o_orderkey, k, d, CASE WHEN a <= DATE '2001-09-01' THEN a ELSE b END AS c FROM o)
SELECT o_orderkey, strftime(CASE WHEN k = 3 THEN DATE '2001-07-04' WHEN year(d) >= 2000 THEN d WHEN k = 1 THEN c WHEN k = 2 THEN greatest(c, DATE '2001-07-04') END, '%Y-%m-%d') AS modified FROM y"""
)
def page_last_modified(spark, sf_dir):
    a = long_date(F.col("day"))
    html = choose(F.col("o_orderkey"), (F.concat(F.lit('<meta name="DCTERMS.modified" content="'), F.col("day").cast("string"), F.lit('T10:00:00Z"><p>x</p>')), F.concat(F.lit("<p>Last updated: "), a, F.lit("</p>")), F.concat(F.lit("<p>Order of Jul. 4, then "), a, F.lit("</p>")), "<p>Order of Jul. 4</p>"))
    return orders(spark, sf_dir).select("o_orderkey", dates.page_last_modified(html, day("2001-08-01")).cast("string").alias("modified"))


@query(
    """WITH d AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 5 AS b FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 AND year(a) >= 2000 THEN strftime(a, '%Y-%m-%d') END AS start_date, CASE WHEN k < 3 AND year(b) >= 2000 THEN strftime(b, '%Y-%m-%d') END AS end_date FROM d"""
)
def advertised_window(spark, sf_dir):
    a, b = (F.date_format(d, "EEEE, MMMM d, yyyy") for d in (F.col("day"), F.date_add("day", 5)))
    forms = (F.concat(F.lit("<p>From: Sunrise "), a, F.lit("</p><p>Until: Sunset "), b, F.lit("</p>")), F.concat(F.lit("half-staff through "), b), F.concat(F.lit("until 5:00 p.m. on "), b, F.lit(". Thanks")), F.concat(F.lit("half-staff since "), a))
    out = orders(spark, sf_dir).select("o_orderkey", dates.advertised_window(choose(F.col("o_orderkey"), forms)).alias("w"))
    return out.select("o_orderkey", F.col("w.start_date").cast("string").alias("start_date"), F.col("w.end_date").cast("string").alias("end_date"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || ' é' WHEN 1 THEN 'café ' || c_custkey WHEN 2 THEN c_name WHEN 3 THEN '=?x-none?q?' || c_custkey || '?=' ELSE '' END AS subject FROM customer")
def decoded_headers(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    b = F.concat(F.lit("=?utf-8?B?"), F.base64(F.concat(name, F.lit(" é")).cast("binary")), F.lit("?="))
    forms = (b, F.concat(F.lit("=?utf-8?q?caf=C3=A9_"), k.cast("string"), F.lit("?=")), name, F.concat(F.lit("=?x-none?q?"), k.cast("string"), F.lit("?=")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.decode_header(choose(k, forms)).alias("subject"))


# --- rules ----------------------------------------------------------------------------------------

_STATUS = (
    ("there is no current half-staff order", "full", "negation: 'no current half-staff'"),
    ("lowered to half-staff, then returned to full staff at noon", "unknown", "ambiguous: 'to half-staff' and 'full staff' both present"),
    ("Gov. Whit Lowers Flags to Honor a Fire Fighter", "half", "Lowers Flags"),
    ("Governor Ned Lam Directs Flags Lowered", "half", "Flags Lowered"),
    ("flags <b>are at&nbsp;full staff</b> today", "full", "at full staff"),
    ("nothing to see here", "unknown", None),
)
_AUTHORITY = (
    ("Gov. Cox orders flags lowered", "governor", "Gov. Cox orders flags lowered"),
    ("Governor Cox orders flags lowered by order of the President", "governor", "governor acted, referencing federal: 'Governor Cox orders flags lowered'"),
    ("By order of the President of these", "president", "By order of the President"),
    ("a press release", "unknown", None),
)
_DECLARED = (
    ("Flag Status: Full Staff", "full"),
    ("Current status: half", "half"),
    ("United States Flag: Full-Staff Allegheny County Only United States Flags: Half-Staff", "full"),
    ("the flag of the state are currently at Half Staff", "half"),
    ("Flags at Full-Staff", "full"),
    ("Newsroom Flags at Half-Staff", "unknown"),
    ("the flag may be flown at half-staff by presidential order", "unknown"),
    ("<p>United States flag to be flown at half&nbsp;staff</p>", "half"),
)
_TOGGLE = (
    ('<div class="text flag-status"><a href="/flag-status-half.html"><img src="half-staff.png">Flag Status: Half-Staff</a></div>', "half"),
    ('<a href="/flag-status-half.html">x</a><a href="/flag-status-full.html">y</a>', "unknown"),
    ('<div class="flag_status"><img src="full-staff.png">Flag status: half-staff</div>', "unknown"),
    ('<p><a href="/our-flag-status-full.html">flags</a></p>', "full"),
    ("<p>none</p>", "unknown"),
)


@query(f"SELECT o_orderkey, {case_sql('o_orderkey', tuple(x[1] for x in _STATUS))} AS status, {case_sql('o_orderkey', tuple(x[2] for x in _STATUS))} AS evidence FROM orders")
def classify_status(spark, sf_dir):
    t = choose(F.col("o_orderkey"), tuple(x[0] for x in _STATUS))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.classify_status(t).alias("s")).select("o_orderkey", F.col("s.value").alias("status"), "s.evidence")


@query(f"SELECT o_orderkey, {case_sql('o_orderkey', tuple(x[1] for x in _AUTHORITY))} AS authority, {case_sql('o_orderkey', tuple(x[2] for x in _AUTHORITY))} AS evidence FROM orders")
def classify_authority(spark, sf_dir):
    t = choose(F.col("o_orderkey"), tuple(x[0] for x in _AUTHORITY))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.classify_authority(t).alias("s")).select("o_orderkey", F.col("s.value").alias("authority"), "s.evidence")


@query(f"SELECT o_orderkey, {case_sql('o_orderkey', tuple(x[1] for x in _DECLARED))} AS status FROM orders")
def declared_status(spark, sf_dir):
    t = choose(F.col("o_orderkey"), tuple(x[0] for x in _DECLARED))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.current_status(t)["value"].alias("status"))


@query(f"SELECT o_orderkey, {case_sql('o_orderkey', tuple(x[1] for x in _TOGGLE))} AS status FROM orders")
def toggle_status(spark, sf_dir):
    t = choose(F.col("o_orderkey"), tuple(x[0] for x in _TOGGLE))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.toggle_status(t)["value"].alias("status"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Kent' ELSE 'Adams' END AS county, CASE WHEN n_nationkey % 3 = 0 THEN 'half' ELSE 'full' END AS status FROM nation UNION ALL SELECT n_nationkey, 'York', 'half' FROM nation")
def county_exceptions(spark, sf_dir):
    k = F.col("n_nationkey")
    one = F.concat(F.lit("Full-Staff "), F.when(k % 2 == 0, "Kent").otherwise("Adams"), F.lit(" County Only United States Flags: "), F.when(k % 3 == 0, "Half").otherwise("Full"), F.lit("-Staff. "))
    t = F.concat(F.lit("United States Flag: "), one, one, F.lit("<p>York county only flags: half staff</p>"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(rules.county_exceptions(t)).alias("c")).select("n_nationkey", "c.county", "c.status")


# --- items ----------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders)
SELECT o_custkey, CAST(ordinal AS INTEGER) AS ordinal, 'Order & ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' half-staff' ELSE '' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'https://base/' || o_custkey ELSE 'https://x/' || o_orderkey END AS url,
  CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderkey % 2 = 0 AS is_flag FROM r WHERE ordinal < 80"""
)
def feed_items(spark, sf_dir):
    k = F.col("o_orderkey")
    link = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("<link>https://x/"), k.cast("string"), F.lit("</link>"))).otherwise(F.concat(F.lit('<link rel="a" href="https://x/'), k.cast("string"), F.lit('"/>')))
    item = F.concat(F.lit("<item><title><![CDATA[Order &amp; "), k.cast("string"), F.when(k % 2 == 0, " half-staff").otherwise(""), F.lit("]]></title>"), link, F.lit("<pubDate>"), F.date_format("day", "EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT</pubDate></item>"))
    feeds = orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("i"))
    xml = F.concat(F.lit("<rss><title>feed</title>"), F.array_join(F.transform("i", lambda x: x["item"]), "\n"), F.lit("</rss>"))
    out = items.exploded(feeds.select("o_custkey", xml.alias("xml")), items.feed_items(F.col("xml"), F.concat(F.lit("https://base/"), F.col("o_custkey").cast("string"))), "o_custkey")
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    """SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN year(o_orderdate) >= 2000 THEN CAST(o_orderdate AS DATE) END DESC NULLS LAST, o_orderkey) - 1 AS INTEGER) AS rank,
  'Flags at half-staff ' || o_orderkey || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS title, 'https://s.example.org/o/' || o_orderkey AS url, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders"""
)
def archive_items(spark, sf_dir):
    k = F.col("o_orderkey")
    item = F.concat(F.lit('<li><a href="/o/'), k.cast("string"), F.lit('">Flags at half-staff '), k.cast("string"), F.lit("</a> "), F.col("day").cast("string"), F.lit("</li>"))
    pages = orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("i"))
    html = F.concat(F.lit("<div><li>short</li><article><article>flag order twice</article>"), F.array_join(F.transform("i", lambda x: x["item"]), ""), F.lit("<a>flag order</a></div>"))
    out = items.archive_items(pages.select("o_custkey", html.alias("html"), F.lit("https://s.example.org/list/").alias("url")), ("o_custkey",))
    return out.filter("title <> 'flag order'").withColumn("date", F.col("date").cast("string"))


@query(
    """WITH raw AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')) AS b FROM pages UNION ALL SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<h1\\b[^>]*>.*?</h1>')) FROM pages
  UNION ALL SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<h2\\b[^>]*>.*?</h2>')) FROM pages UNION ALL SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<h3\\b[^>]*>.*?</h3>')) FROM pages
  UNION ALL SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<h4\\b[^>]*>.*?</h4>')) FROM pages
), t AS (SELECT page_id, regexp_replace(regexp_replace(b, '<script\\b.*?</script>', ' ', 'gis'), '<[^>]+>', ' ', 'g') AS x, regexp_extract(b, '(?i)href=["''](.*?)["'']', 1) AS href FROM raw),
c AS (SELECT page_id, href, trim(regexp_replace("""
    + _ENTITY_SQL
    + """, '\\s+', ' ', 'g')) AS txt FROM t)
SELECT page_id, txt[1:200] AS title, href, count(*) AS n FROM c WHERE length(txt) BETWEEN 12 AND 300 AND regexp_matches(lower(txt), 'the|and|der') GROUP BY ALL"""
)
def index_headlines(spark, sf_dir):
    rows = items.exploded(table(spark, sf_dir, "pages"), items.index_blocks(F.col("html"), "(?iU)the|and|der"), "page_id")
    return rows.groupBy("page_id", "title", "href").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS ordinal FROM lineitem)
SELECT l_suppkey, CAST(ordinal AS INTEGER) AS ordinal, 'Line ' || l_orderkey || '-' || l_linenumber AS title FROM r WHERE ordinal < 80 AND l_linenumber <> 5"""
)
def first_items_of_long_feeds(spark, sf_dir):
    said = F.when(F.col("l_linenumber") == 5, "").otherwise(F.concat(F.lit("Line "), F.concat_ws("-", "l_orderkey", "l_linenumber")))
    entry = F.concat(F.lit("<entry><title>"), said, F.lit("</title></entry>"))
    feeds = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", entry.alias("entry")))).alias("i"))
    xml = F.concat(F.lit("<feed>"), F.array_join(F.transform("i", lambda x: x["entry"]), ""), F.lit("</feed>"))
    return items.exploded(feeds.select("l_suppkey", xml.alias("xml")), items.feed_items(F.col("xml"), F.lit("https://base/")), "l_suppkey").select("l_suppkey", "ordinal", "title")


def _folded(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string"))).alias("url"), F.concat(F.lit("T"), (F.col("event_id") % 5).cast("string"), F.col("event_type")).alias("title")))).alias("items")
    )
    return rows


@query(
    """WITH RECURSIVE e AS (
  SELECT user_id, event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'u' || (event_id % 7) END AS url, lower('T' || (event_id % 5) || event_type) AS title, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), f AS (
  SELECT user_id, i, [url] AS urls, [title] AS titles, [event_id] AS kept FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, CASE WHEN ok THEN list_append(urls, url) ELSE urls END, CASE WHEN ok THEN list_append(titles, title) ELSE titles END, CASE WHEN ok THEN list_append(kept, event_id) ELSE kept END
  FROM (SELECT e.*, f.urls, f.titles, f.kept, NOT ((e.url <> '' AND list_contains(f.urls, e.url)) OR list_contains(f.titles, e.title)) AS ok FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) e
), l AS (SELECT user_id, max_by(kept, i) AS kept FROM f GROUP BY user_id)
SELECT user_id, unnest(kept) AS event_id FROM l"""
)
def dedupe_in_order(spark, sf_dir):
    return _folded(spark, sf_dir).select("user_id", F.explode(items.dedupe_in_order(F.col("items"))).alias("x")).select("user_id", "x.event_id")


# --- coverage and state ---------------------------------------------------------------------------

_COVERS_SQL = """CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s <= d AND d <= e WHEN e IS NOT NULL THEN d <= e WHEN s = d THEN true WHEN s > d THEN false WHEN s IS NOT NULL THEN d - s <= 2 END"""


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS s, CASE WHEN l_orderkey % 4 <> 1 THEN CAST(l_shipdate AS DATE) END AS e, CAST(o_orderdate AS DATE) + CAST(l_linenumber AS INTEGER) * 2 - 3 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, {_COVERS_SQL} AS verdict FROM x"""
)
def covers_day(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "day")
    x = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    s, e = F.when(F.col("l_orderkey") % 3 != 0, F.col("day")), F.when(F.col("l_orderkey") % 4 != 1, F.to_date("l_shipdate"))
    return x.select("l_orderkey", "l_linenumber", coverage.covers(s, e, F.date_add("day", F.col("l_linenumber") * 2 - 3))["verdict"].alias("verdict"))


@query(
    """WITH w AS (SELECT CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS e FROM orders), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM d JOIN w ON d BETWEEN s AND e GROUP BY d"""
)
def covered_days(spark, sf_dir):
    o = orders(spark, sf_dir)
    w = o.select(F.col("day").alias("s"), F.date_add("day", (F.col("o_orderkey") % 40).cast("int")).alias("e"))
    return coverage.covered_days(w, o.select(F.col("day").alias("d")).distinct(), "s", "e", "d").groupBy("d").agg(F.count("*").alias("n")).select(F.col("d").cast("string").alias("day"), "n")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR CAST(o_orderdate AS DATE) >= DATE '2001-07-11'")
def recent_rows(spark, sf_dir):
    d = F.when(F.col("o_orderkey") % 5 != 0, F.col("day"))
    return orders(spark, sf_dir).filter(coverage.recent(d, day("2001-08-01"))).select("o_orderkey")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 <> 0 THEN DATE '2001-08-01' - CAST(o_orderdate AS DATE) END AS INTEGER) AS age_days, o_orderkey % 5 = 0 AS freshness_unknown, coalesce(o_orderkey % 5 <> 0 AND DATE '2001-08-01' - CAST(o_orderdate AS DATE) > 180, false) AS frozen FROM orders")
def frozen_sources(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", coverage.freshness(F.when(F.col("o_orderkey") % 5 != 0, F.col("day")), day("2001-08-01")).alias("f")).select("o_orderkey", "f.*")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_key(spark, sf_dir):
    return state.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), -F.col("event_id")], ["event_id", "event_type", "value"])


_CHANGES_SQL = """
WITH h AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS previous, row_number() OVER w = 1 AS first_seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, coalesce(previous <> event_type, false) AS changed FROM h)
"""


def _changes(spark, sf_dir):
    return state.detect_changes(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type", "event_id")


@query(_CHANGES_SQL + "SELECT event_id, previous, changed, first_seen, last_value(CASE WHEN changed OR first_seen THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_changed_at FROM c")
def detect_changes(spark, sf_dir):
    return _changes(spark, sf_dir).select("event_id", "previous", "changed", "first_seen", "last_changed_at")


@query(_CHANGES_SQL + """SELECT CAST(user_id AS VARCHAR) AS key, '{"tag":"flag-' || user_id || '","title":"back to full staff","status":"' || event_type || '"}' AS payload FROM c WHERE changed""")
def changed_feed(spark, sf_dir):
    return notices(state.changed_feed(_changes(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string")), "user_id", "ts", "event_type"))


@query(
    """WITH k AS (SELECT event_id, event_type = 'error' AS failed, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS known FROM events)
SELECT event_id, coalesce(known, 'unknown') AS known, CASE WHEN NOT failed THEN 'covered' WHEN known IS NOT NULL THEN 'stale' ELSE 'not_covered' END AS coverage FROM k"""
)
def last_known_good(spark, sf_dir):
    return state.last_known_good(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "error").select("event_id", "known", "coverage")


@query("SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_name ELSE n.c_name END AS c_name, CASE WHEN n.c_custkey IS NULL THEN o.seg ELSE n.seg END AS seg FROM (SELECT c_custkey, c_name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'new' END AS seg FROM customer WHERE c_custkey % 2 = 0) n ON o.c_custkey = n.c_custkey")
def upsert_state(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.col("c_mktsegment").alias("seg"))
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 4 != 0, "new").alias("seg"))
    return state.upsert(old, new, "c_custkey", ["c_name", "seg"])


@query("SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 3 = 0 AND s.event_id % 2 = 0 AND s.user_id = events.user_id AND md5(s.event_type) = md5(events.event_type))")
def documents_to_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.md5("event_type").alias("hash"))
    known = e.filter("event_id % 3 = 0").withColumn("parser_version", F.when(F.col("event_id") % 2 == 0, 8).otherwise(7))
    return state.to_parse(e, known, 8).select("event_id")


# --- history --------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w = 1 AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT * FROM l WHERE first OR p <> event_type) SELECT user_id, event_type, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM m"""
)
def validity_history(spark, sf_dir):
    """The intervals of events in which a user's type stayed the same."""
    return history.validity(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"])


_DAILY_SQL = "e AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1, 2), days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)"


@query(f"WITH {_DAILY_SQL}, k AS (SELECT DISTINCT user_id FROM events) SELECT k.user_id, strftime(days.d, '%Y-%m-%d') AS day, e.status FROM k CROSS JOIN days ASOF JOIN e ON k.user_id = e.user_id AND days.d >= e.d")
def status_on_days(spark, sf_dir):
    """The status of every user on every day that the table has, from intervals of validity; none before a user's first day."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), F.col("event_type").alias("status"), "ts", "event_id")
    held = history.validity(e, "user_id", "d", ["status"], ["ts", "event_id"])
    return history.on_days(held, e.select("d").distinct(), "d", day("2100-01-01")).select("user_id", F.col("d").cast("string").alias("day"), "status")


_VERDICTS_SQL = (
    """WITH o AS (SELECT user_id, ts, event_type = 'error' AS bad, CASE WHEN event_type IN ('click', 'purchase') THEN 'half' ELSE 'full' END AS st, CAST(ts AS DATE) AS d, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 4 END AS e FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-25'),
g AS (SELECT user_id, max(ts) FILTER (NOT bad) AS good_at, arg_max({'st': st, 'd': d, 'e': e}, {'ts': ts, 'st': st, 'd': d, 'e': coalesce(e, DATE '1970-01-01')}) FILTER (NOT bad) AS f FROM o GROUP BY user_id),
h AS (SELECT g.user_id, any_value(good_at) AS good_at, any_value(f) AS f, min(o.ts) AS failed FROM g LEFT JOIN o ON o.user_id = g.user_id AND bad AND (good_at IS NULL OR o.ts > good_at) GROUP BY g.user_id),
n AS (SELECT *, coalesce(CAST(failed AS DATE), DATE '2024-01-25') AS day FROM h)
SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN good_at IS NULL THEN 'unknown' WHEN f.st = 'half' AND NOT (f.d <= day AND CASE WHEN f.e IS NULL THEN day - f.d <= 2 ELSE day <= f.e END AND day - f.d <= 21) THEN 'full' ELSE f.st END AS status,
  CASE WHEN good_at IS NULL THEN 'not_covered' WHEN failed IS NOT NULL THEN 'stale' ELSE 'covered' END AS coverage FROM n"""
)


def _observations(events: DataFrame) -> DataFrame:
    """Events as what is observed of their users."""
    d, null = F.to_date("ts"), F.lit(None)
    return events.select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "HTTP 500").alias("error"), null.cast("string").alias("hash"), F.when(F.col("event_type").isin("click", "purchase"), "half").otherwise("full").alias("status"),
        d.alias("start_date"), F.when(F.col("event_id") % 3 == 0, F.date_add(d, 4)).alias("end_date"), d.alias("item_date"), null.cast("date").alias("modified"),
    )


@query(_VERDICTS_SQL)
def verdicts_on_a_day(spark, sf_dir):
    """What a stream of all events up to a day would show on it: late, failing and concluded sources too."""
    return resolution.verdicts_on(_observations(table(spark, sf_dir, "events")), day("2024-01-25"))


@query(_VERDICTS_SQL)
def verdicts_of_a_stream(spark, sf_dir):
    """What the stream of all events did show at the end of that day, by its turns, of which some come of timers."""
    events = landing.stream_of(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    turns = landing.landed(resolution.resolution_stream(_observations(events).withColumn("at", F.col("at").cast("timestamp"))), "turns", "update")
    last = turns.filter(F.to_date("at") <= day("2024-01-25")).groupBy("key").agg(F.max_by(F.struct("status", "coverage"), F.struct("at", "batch")).alias("v"))
    return last.select("key", "v.*")


@query("SELECT user_id AS key, event_id AS seq, event_type AS content, coalesce(lag(event_type) OVER w <> event_type, false) AS changed, lag(event_type) OVER w IS NULL AS first_seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def changes_of_a_stream(spark, sf_dir):
    """Changes of type by user, over the stream of all events."""
    events = landing.stream_of(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    observed = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    return landing.landed(changes.changes_stream(observed), "changes").select(F.col("key").cast("long").alias("key"), "seq", "content", "changed", "first_seen")


@query("WITH l AS (SELECT user_id, ts, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id % 2 = 0 GROUP BY user_id, ts) SELECT event_id, l.event_type AS known FROM events e ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.ts >= l.ts")
def value_at_a_time(spark, sf_dir):
    """For each event what the events with even numbers told of its user by then."""
    e = table(spark, sf_dir, "events")
    log = e.filter("event_id % 2 = 0").select("user_id", "ts", F.col("event_type").alias("known"), "event_id")
    return history.value_at(e.select("user_id", "ts", "event_id"), log, "user_id", "ts", ["known"], ["event_id"]).select("event_id", "known")


# --- resolution -----------------------------------------------------------------------------------


@query(
    """WITH i AS (SELECT user_id, event_id, event_type, CAST(ts AS DATE) AS d, event_type IN ('click', 'purchase') AS half, event_type = 'purchase' AND event_id % 4 = 0 AS lim, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 4 END AS e FROM events),
u AS (SELECT *, coalesce(CASE WHEN e IS NOT NULL THEN d <= DATE '2024-01-25' AND DATE '2024-01-25' <= e WHEN d = DATE '2024-01-25' THEN true WHEN d > DATE '2024-01-25' THEN false ELSE DATE '2024-01-25' - d <= 2 END, false) AS live FROM i WHERE half AND NOT lim AND d >= DATE '2024-01-04'),
b AS (SELECT user_id, arg_min(event_id, (NOT live, event_id)) AS event_id, bool_or(live) AS live FROM u GROUP BY user_id)
SELECT a.user_id, CASE WHEN coalesce(live, false) THEN 'half' ELSE 'full' END AS status, CASE WHEN live THEN b.event_id END AS taken, CASE WHEN NOT live THEN b.event_id END AS expired FROM (SELECT DISTINCT user_id FROM events) a LEFT JOIN b ON a.user_id = b.user_id"""
)
def fold_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = F.to_date("ts")
    rows = e.select(
        "user_id", F.col("event_id").alias("ordinal"), F.col("event_id").cast("string").alias("title"), d.alias("date"), F.when(F.col("event_type").isin("click", "purchase"), "half").otherwise("full").alias("status"), F.lit("governor").alias("authority"),
        F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), "limited").otherwise("statewide").alias("scope"), F.lit(None).cast("date").alias("start_date"), F.when(F.col("event_id") % 3 == 0, F.date_add(d, 4)).alias("end_date"),
    )
    return resolve.fold_candidates(rows, "user_id", day("2024-01-25")).select("user_id", "status", F.col("order.ordinal").alias("taken"), F.col("last_expired_order.ordinal").alias("expired"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'diff' WHEN s_suppkey % 7 = 0 THEN 'patched' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'nation ' || s_nationkey END AS note FROM supplier")
def apply_patches(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("note"))
    none = F.array().cast("array<string>")
    one = base.filter("s_suppkey % 7 = 0").select("s_suppkey", F.lit(1).alias("seq"), F.lit("patched").alias("s_name"), F.lit(None).cast("string").alias("note"), none.alias("removed"))
    two = base.filter("s_suppkey % 5 = 0").select("s_suppkey", F.lit(2).alias("seq"), F.lit("diff").alias("s_name"), F.lit(None).cast("string").alias("note"), F.array(F.lit("note")).alias("removed"))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("s_suppkey"), F.lit(3).alias("seq"), F.lit("never inserted").alias("s_name"), F.lit(None).cast("string").alias("note"), none.alias("removed"))
    return patch.apply_patches(base, one.union(two).union(extra), "s_suppkey", ["s_name", "note"])


@query(ORACLES["apply_patches"])
def rewritten_registry(spark, sf_dir):
    """A registry that is patched from the version that it replaces: the second version, as the store has it."""
    import uuid

    from halyard.sources.scratch import shared_dir
    from halyard.sources.versions import Store

    store = Store(spark, f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}")
    draft = store.begin("1")
    draft.keep(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("note")), "registry")
    base = draft.commit().table("registry")
    none = F.array().cast("array<string>")
    one = base.filter("s_suppkey % 7 = 0").select("s_suppkey", F.lit(1).alias("seq"), F.lit("patched").alias("s_name"), F.lit(None).cast("string").alias("note"), none.alias("removed"))
    two = base.filter("s_suppkey % 5 = 0").select("s_suppkey", F.lit(2).alias("seq"), F.lit("diff").alias("s_name"), F.lit(None).cast("string").alias("note"), F.array(F.lit("note")).alias("removed"))
    draft = store.begin("2")
    draft.keep(patch.apply_patches(base, one.union(two), "s_suppkey", ["s_name", "note"]), "registry")
    draft.commit()
    return store.latest().table("registry")


_CALENDAR = "VALUES (0, 'peace-officers-memorial-day', DATE '2026-05-15', true, 'full-day', 'Honoring officers'), (1, 'memorial-day', DATE '2026-05-25', true, 'until-noon', 'Honoring the fallen'), (2, 'second-on-the-day', DATE '2026-05-25', true, 'full-day', 'Another'), (3, 'lapsed', DATE '2026-07-27', false, 'full-day', 'Lapsed')"


def _calendar(spark) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_CALENDAR} AS c(ordinal, id, date, active, scope, reason)")


@query(
    "WITH o AS (SELECT DATE '2026-01-01' + CAST(dayofyear(o_orderdate) - 1 AS INTEGER) AS d, count(*) AS n FROM orders GROUP BY 1), c(ordinal, id, date, active, scope, reason) AS (" + _CALENDAR + ") "
    "SELECT id, strftime(d, '%Y-%m-%d') AS date, scope, reason, n FROM o JOIN c ON d = date WHERE active AND ordinal < 2"
)
def calendar_lookup(spark, sf_dir):
    """The observances of the days of the year on which there are orders, and how many these are."""
    o = orders(spark, sf_dir).select(F.date_add(F.lit("2026-01-01").cast("date"), F.dayofyear("day") - 1).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return resolve.observances_of_days(_calendar(spark), o, "d").select("id", F.col("d").cast("string").alias("date"), "scope", "reason", "n")


@query(
    """SELECT c_custkey, 'on' AS day, 'half' AS effective_status, 'Honoring the fallen' AS reason, 'federal' AS reason_source, 'until-noon' AS scope FROM customer
UNION ALL SELECT c_custkey, 'off', CASE c_custkey % 3 WHEN 0 THEN 'half' WHEN 1 THEN 'full' ELSE 'unknown' END, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'State order' END END,
  CASE WHEN c_custkey % 3 = 0 THEN 'state' END, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'until-noon' ELSE 'full-day' END END FROM customer"""
)
def federal_overlay(spark, sf_dir):
    k = F.col("c_custkey")
    states = table(spark, sf_dir, "customer").select("c_custkey", choose(k, ("half", "full", "unknown")).alias("status"), F.when(k % 2 == 0, F.col("c_name")).alias("order_title"), (k % 4 == 0).alias("until_noon"))
    out = []
    for name, d in (("on", "2026-05-25"), ("off", "2026-05-26")):
        out.append(resolve.overlay(states, resolve.statutory_observance(_calendar(spark), day(d))).select("c_custkey", F.lit(name).alias("day"), "effective_status", "reason", "reason_source", "scope"))
    return out[0].union(out[1])


@query(
    """WITH o AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS s FROM orders WHERE o_custkey % 4 <> 0 GROUP BY o_custkey), x AS (SELECT c_custkey, s, c_custkey % 3 = 0 AS heard FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT c_custkey, CASE WHEN s IS NOT NULL AND DATE '2001-07-31' - s BETWEEN 0 AND 2 THEN 'half' WHEN s IS NOT NULL OR heard THEN 'full' ELSE 'unknown' END AS status, CASE WHEN s IS NOT NULL OR heard THEN 'covered' ELSE 'not_covered' END AS coverage FROM x"""
)
def email_status(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = orders(spark, sf_dir).filter("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("day").alias("start_date")).withColumn("end_date", F.lit(None).cast("date"))
    seen = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("2001-07-01").alias("seen_on"))
    return resolve.email_status(c, o, seen, day("2001-07-31"), "c_custkey").select("c_custkey", "status", "coverage")


@query(
    """WITH x AS (SELECT c_custkey, [c_custkey, c_custkey + 1, c_custkey, c_custkey + 2] AS t FROM customer), y AS (SELECT c_custkey, list_filter(t, lambda k: k % 3 = 0)[1] AS k FROM x)
SELECT c_custkey, 'http://h/' || k AS used_url, 'page ' || k AS html, CASE WHEN k IS NULL THEN 'HTTP 404' END AS error FROM y"""
)
def alternate_urls(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    url = lambda n: F.concat(F.lit("http://h/"), n.cast("string"))
    reg = c.select("c_custkey", url(F.col("c_custkey")).alias("url"), F.array(url(F.col("c_custkey") + 1), url(F.col("c_custkey")), url(F.col("c_custkey") + 2)).alias("url_candidates"))
    keys = c.select(F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1, F.col("c_custkey") + 2)).alias("n")).distinct()
    fetched = keys.select(url(F.col("n")).alias("url"), F.when(F.col("n") % 3 == 0, 200).otherwise(404).alias("status"), F.concat(F.lit("page "), F.col("n").cast("string")).alias("body"), F.lit(None).cast("string").alias("error"))
    return resolve.with_alternates(reg, landed_documents(fetched), "c_custkey").select("c_custkey", "used_url", "html", "error")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'press' WHEN 2 THEN 'rss' WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'flag' ELSE 'press' END ELSE 'press' END AS url FROM customer")
def pick_url(spark, sf_dir):
    k = F.col("c_custkey")
    row = F.struct(choose(k, ("email", "toggle", "feed", "diff", "index")).alias("ingest_mode"), F.lit("").alias("toggle_hub_url"), F.lit("press").alias("press_url"), F.lit("rss").alias("rss_url"), F.when(k % 2 == 0, "flag").otherwise("").alias("flag_page_url"))
    return table(spark, sf_dir, "customer").select("c_custkey", row.alias("r")).select("c_custkey", resolve.pick_url(F.col("r")).alias("url"))


_COVERAGE = ("covered", "covered", "not_covered", "stale")
_ERRORS = (None, "robots.txt disallows", "HTTP 404", "ReadTimeout", "source frozen for 200 days", "something else that is rather longer than forty characters", "")


@query("SELECT count(*) FILTER (event_id % 4 < 2) AS covered, count(*) FILTER (event_id % 4 = 2) AS not_covered, count(*) FILTER (event_id % 4 = 3) AS stale, count(*) FILTER (event_id % 7 BETWEEN 1 AND 5) AS errors, count(*) AS total FROM events")
def coverage_counts(spark, sf_dir):
    k = F.col("event_id")
    return resolve.coverage_counts(resolve.publishable(table(spark, sf_dir, "events").select(choose(k, _COVERAGE).alias("coverage"), choose(k, _ERRORS).alias("error"))))


@query("SELECT " + case_sql("event_id", (None, "blocked by robots.txt", "HTTP error", "timeout", "frozen source", "something else that is rather longer tha", None)) + " AS cause, count(*) AS n FROM events WHERE event_id % 7 BETWEEN 1 AND 5 GROUP BY 1")
def error_causes(spark, sf_dir):
    return resolve.error_causes(table(spark, sf_dir, "events").select(choose(F.col("event_id"), _ERRORS).alias("error")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN o_orderpriority END AS body FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def enrich_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("body"))
    return resolve.enrich(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), o, F.col("l_linenumber") == 1, "l_orderkey", ["body"])


# --- every pattern of the rules, behind whole documents --------------------------------------------

# text, status, evidence: one text for each pattern that can decide
_STATUS_TEXTS = (
    ("There is no current half-staff notice", "full", "negation: 'no current half-staff'"), ("There are no active flag orders", "full", "negation: 'no active flag orders'"), ("It is not currently at half-staff", "full", "negation: 'not currently at half-staff'"),
    ("The half-staff order has expired", "full", "negation: 'half-staff order has expired'"), ("No flags are currently lowered", "full", "negation: 'No flags are currently lowered'"),
    ("Flags at half mast", "half", "at half mast"), ("It goes to half-staff", "half", "to half-staff"), ("A half-staff day", "half", "half-staff"), ("The flag will be lowered", "half", "flag will be lowered"), ("We lower the flags", "half", "lower the flags"),
    ("Whitmer Lowers Flags", "half", "Lowers Flags"), ("Flags lowered here", "half", "Flags lowered"),
    ("They fly at full-staff", "full", "at full-staff"), ("A full staff day", "full", "full staff"), ("They returned to the top", "full", "returned to the top"), ("It was raised to the peak", "full", "raised to the peak"), ("There is no current orderly queue", "full", "no current order"), ("The flag is currently flying full", "full", "flag is currently flying full"),
    ("First to half-staff, then full staff", "unknown", "ambiguous: 'to half-staff' and 'full staff' both present"), ("Nothing of the kind", "unknown", None),
)
_AUTHORITY_TEXTS = (
    ("The President of the United States speaks", "president", "The President of the United States"), ("a presidential proclamation", "president", "presidential proclamation"), ("by order of the President", "president", "by order of the President"), ("President has ordered it", "president", "President has ordered"),
    ("from the White House", "president", "White House"), ("at all federal buildings", "president", "all federal buildings"), ("the authority vested in me by the Constitution and the laws of the United States", "president", "authority vested in me by the Constitution and the laws of the United States"), ("at United States embassies, legations", "president", "United States embassies, legations"),
    ("Governor Cox has directed it", "governor", "Governor Cox has directed"), ("a governor's flag order", "governor", "governor's flag order"), ("by order of the governor", "governor", "by order of the governor"), ("a governor's proclamation", "governor", "governor's proclamation"), ("see Executive Order No. 2026-5", "governor", "Executive Order No. 2026-5"), ("The mayor has ordered it", "governor", "The mayor has ordered"),
    ("Governor Cox orders it by order of the President", "governor", "governor acted, referencing federal: 'Governor Cox orders'"), ("nobody in particular", "unknown", None),
)
_DECLARED_TEXTS = (
    ("Flag Status: Full Staff", "full", "Flag Status: Full Staff"), ("Flag Status Full Staff", "full", "Flag Status Full Staff"), ("Status: FULL STAFF", "full", "Status: FULL STAFF"), ("Current status: half the day", "half", "Current status: half"), ("National Flag: Half Staff", "half", "National Flag: Half Staff"), ("United States Flag: Full-Staff", "full", "United States Flag: Full-Staff"),
    ("An honor status notification including text, Full Staff", "full", "status notification including text, Full Staff"), ("They are currently at Half Staff", "half", "are currently at Half Staff"), ("Flags are at full staff", "full", "Flags are at full staff"), ("Flags will be flown at half-staff today", "half", "Flags will be flown at half-staff today"),
    ("She has ordered that banners be lowered to half-staff", "half", "has ordered that banners be lowered to half-staff"), ("Flags to be flown at half staff", "half", "Flags to be flown at half staff"), ("Flags at Full-Staff", "full", "Flags at Full-Staff"), ("In the newsroom: Flags at Half-Staff", "unknown", None), ("Flags may be flown at half-staff", "unknown", None),
)
_APART = "- " * 40


def _behind_documents(spark, sf_dir, texts):
    """Every document's whole text, and behind it one of these texts, which alone speaks of flags."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" " + _APART), choose(F.col("doc_id"), tuple(x[0] for x in texts)))
    return table(spark, sf_dir, "documents").select("doc_id", said.alias("said"))


def _rule_sql(texts, prefix=""):
    shown = tuple(x[2] if x[2] is None else f"{prefix}'{x[2]}'" if prefix else x[2] for x in texts)
    return f"SELECT doc_id, {case_sql('doc_id', tuple(x[1] for x in texts))} AS value, {case_sql('doc_id', shown)} AS evidence FROM documents"


@query(_rule_sql(_STATUS_TEXTS))
def every_status_signal(spark, sf_dir):
    return _behind_documents(spark, sf_dir, _STATUS_TEXTS).select("doc_id", rules.classify_status(F.col("said")).alias("r")).select("doc_id", "r.*")


@query(_rule_sql(_AUTHORITY_TEXTS))
def every_authority_signal(spark, sf_dir):
    return _behind_documents(spark, sf_dir, _AUTHORITY_TEXTS).select("doc_id", rules.classify_authority(F.col("said")).alias("r")).select("doc_id", "r.*")


@query(_rule_sql(_DECLARED_TEXTS, "declaration: "))
def every_declaration(spark, sf_dir):
    r = rules.current_status(F.col("said")).alias("r")
    told = F.when(F.col("r.value") != "unknown", F.col("r.evidence")).alias("evidence")
    return _behind_documents(spark, sf_dir, _DECLARED_TEXTS).select("doc_id", r).select("doc_id", "r.value", told)


# text, status, evidence: one badge or link for each way to vote
_TOGGLE_TEXTS = (
    ('<div class="flag-status"><a href="/flag-status-half.html"><img src="half-staff.png">Flag Status: Half-Staff</a></div>', "half", "flag-status widget (href+image+text all say half)"),
    ('<div class="flag_status">Flags status - Full Staff</div>', "full", "flag-status widget (text all say full)"), ('<span class="x flag-status y"><img src="Full-Staff.svg"></span>', "full", "flag-status widget (image all say full)"),
    ('<p class="flag-status"><a href="flagstatus_half">x</a></p>', "half", "flag-status widget (href all say half)"), ('<div class="flag_status"><img src="full-staff.jpg">Flag status: half-staff</div>', "unknown", "flag-status widget disagrees with itself: text=half, image=full"),
    ('<a href="/flag-status-half">x</a><a href="/flag-status-full">y</a>', "unknown", "both half and full variants present in the source"), ('<a href="/flag-status/now-half">x</a><a href="/flag-status/now-full">y</a>', "unknown", "both half and full pages linked, and no flag-status widget"),
    ('<a href="/our-flag-status-half.html">x</a>', "half", "only half page linked: /our-flag-status-half.html"), ('<a href="/flag_status_full">x</a>', "full", "only full page linked: /flag_status_full"), ("<p>none</p>", "unknown", "no flag-status link found on this page"),
)


@query(_rule_sql(_TOGGLE_TEXTS))
def every_toggle_vote(spark, sf_dir):
    return _behind_documents(spark, sf_dir, _TOGGLE_TEXTS).select("doc_id", rules.toggle_status(F.col("said")).alias("r")).select("doc_id", "r.*")


# --- messages -------------------------------------------------------------------------------------


def _mail(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    sender = choose(k, (F.concat(F.lit("Office <news@"), F.lower(F.translate("n_name", " ", "-")), F.lit(".gov>")), F.lit("list@delivery.example"), F.lit("list@delivery.example"), F.lit("x@accounts.google.com")))
    headers = F.when(k % 4 == 1, F.concat(F.lit("acct"), F.col("n_nationkey").cast("string"), F.lit(".list"))).otherwise("")
    subject = F.when(k % 4 == 2, F.concat(F.lit("Flags lowered in "), F.initcap("n_name"))).when(k % 8 == 0, "No news").otherwise("Flags lowered to half-staff")
    return c.select(k.alias("msg_id"), k.alias("seq"), sender.alias("sender"), subject.alias("subject"), headers.alias("headers"), F.lit("Tue, 18 Aug 2026 10:00:00 -0400").alias("date"), F.array(F.struct(F.lit("text/plain").alias("ctype"), F.lit(None).cast("string").alias("filename"), F.lit("by order of the governor").alias("text"))).alias("parts"), "n_nationkey", "n_name")


def _dimensions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    code = F.col("n_nationkey").cast("string").alias("code")
    hints = n.select(F.col("n_nationkey").alias("priority"), F.concat(F.lower(F.translate("n_name", " ", "-")), F.lit(".gov")).alias("domain"), code)
    accounts = n.select(F.col("n_nationkey").alias("priority"), F.concat(F.lit("acct"), code).alias("slug"), code)
    return hints, accounts, n.select(code, F.col("n_name").alias("name"))


_MAIL_SQL = """WITH m AS (SELECT c_custkey, c_custkey % 4 AS k, n.n_nationkey, n.n_name, lower(replace(n.n_name, ' ', '-')) || '.gov' AS own FROM customer JOIN nation n ON c_nationkey = n.n_nationkey),
dom AS (SELECT c_custkey, min(h.n_nationkey) AS h FROM m JOIN nation h ON k = 0 AND contains('office <news@' || own || '>', lower(replace(h.n_name, ' ', '-')) || '.gov') GROUP BY c_custkey),
sub AS (SELECT c_custkey, count(*) AS n, min(CAST(h.n_nationkey AS VARCHAR)) AS h FROM m JOIN nation h ON k = 2 AND contains(lower('flags lowered in ' || m.n_name), lower(h.n_name)) GROUP BY c_custkey)
"""


@query(
    _MAIL_SQL
    + """SELECT m.c_custkey AS msg_id, CASE WHEN k = 0 THEN CAST(dom.h AS VARCHAR) WHEN k = 1 THEN CAST(m.n_nationkey AS VARCHAR) WHEN k = 2 AND sub.n = 1 THEN sub.h END AS code,
CASE WHEN k = 0 THEN 'sender domain ' || lower(replace(h.n_name, ' ', '-')) || '.gov' WHEN k = 1 THEN 'govdelivery account ACCT' || m.n_nationkey WHEN k = 2 AND sub.n = 1 THEN 'state named in subject' WHEN k = 2 THEN 'subject names ' || sub.n || ' states - ambiguous' ELSE 'no state identified' END AS how
FROM m LEFT JOIN dom ON m.c_custkey = dom.c_custkey LEFT JOIN nation h ON dom.h = h.n_nationkey LEFT JOIN sub ON m.c_custkey = sub.c_custkey"""
)
def sender_attribution(spark, sf_dir):
    return attribution.attribute(_mail(spark, sf_dir), *_dimensions(spark, sf_dir))


@query(ORACLES["sender_attribution"])
def attribution_by_index(spark, sf_dir):
    """The same from an inverted index, as for very many domains, accounts and names."""
    return attribution.attributed_by_index(_mail(spark, sf_dir), *_dimensions(spark, sf_dir)).select("msg_id", "code", "how")


@query(
    _MAIL_SQL
    + """, ok AS (SELECT * FROM nation WHERE n_regionkey < 3),
d2 AS (SELECT c_custkey, min(h.n_nationkey) AS h FROM m JOIN ok h ON k = 0 AND contains('office <news@' || own || '>', lower(replace(h.n_name, ' ', '-')) || '.gov') GROUP BY c_custkey),
s2 AS (SELECT c_custkey, count(*) AS n, min(CAST(h.n_nationkey AS VARCHAR)) AS h FROM m JOIN ok h ON k = 2 AND contains(lower('flags lowered in ' || m.n_name), lower(h.n_name)) GROUP BY c_custkey)
SELECT m.c_custkey AS msg_id, CASE WHEN k = 0 THEN CAST(d2.h AS VARCHAR) WHEN k = 1 AND m.n_nationkey IN (SELECT n_nationkey FROM ok) THEN CAST(m.n_nationkey AS VARCHAR) WHEN k = 2 AND s2.n = 1 THEN s2.h END AS code
FROM m LEFT JOIN d2 ON m.c_custkey = d2.c_custkey LEFT JOIN s2 ON m.c_custkey = s2.c_custkey"""
)
def attribution_to_allowed_keys(spark, sf_dir):
    allowed = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("code"))
    return attribution.attribute(_mail(spark, sf_dir), *_dimensions(spark, sf_dir), allowed).select("msg_id", "code")


@query(
    """SELECT c_custkey AS msg_id, CASE WHEN c_custkey % 4 = 3 THEN 'not flag-related' WHEN c_custkey % 8 = 0 THEN 'not flag-related' WHEN c_custkey % 4 = 2 AND n > 1 THEN 'subject names ' || n || ' states - ambiguous' END AS reason
FROM customer JOIN (SELECT a.n_nationkey, count(*) AS n FROM nation a JOIN nation b ON contains(lower(a.n_name), lower(b.n_name)) GROUP BY 1) ON c_nationkey = n_nationkey"""
)
def parse_messages(spark, sf_dir):
    return messages.parse_messages(_mail(spark, sf_dir), *_dimensions(spark, sf_dir)).select("msg_id", "reason")


@query(
    _MAIL_SQL
    + """, a AS (SELECT m.c_custkey, CASE WHEN k = 0 AND m.c_custkey % 8 = 4 THEN CAST(dom.h AS VARCHAR) WHEN k = 1 THEN CAST(m.n_nationkey AS VARCHAR) WHEN k = 2 AND sub.n = 1 THEN sub.h END AS code
FROM m LEFT JOIN dom ON m.c_custkey = dom.c_custkey LEFT JOIN sub ON m.c_custkey = sub.c_custkey)
SELECT code AS state_code, min(c_custkey) AS msg_id, '2026-08-18' AS sent_date FROM a WHERE code IS NOT NULL GROUP BY code"""
)
def latest_orders(spark, sf_dir):
    return messages.latest_orders(messages.parse_messages(_mail(spark, sf_dir), *_dimensions(spark, sf_dir))).select("state_code", "msg_id", F.col("sent_date").cast("string").alias("sent_date"))


@query(
    """WITH n AS (SELECT user_id, arg_max(strftime(ts, '%Y-%m-%d'), event_id) AS seen_on FROM events WHERE event_type <> 'error' AND event_id % 5 <> 0 GROUP BY user_id), p AS (SELECT DISTINCT user_id, '2023-01-01' AS seen_on FROM events WHERE user_id % 2 = 0)
SELECT CAST(coalesce(n.user_id, p.user_id) AS VARCHAR) AS state_code, coalesce(n.seen_on, p.seen_on) AS seen_on FROM n FULL JOIN p ON n.user_id = p.user_id"""
)
def channels_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("state_code", F.col("user_id").cast("string"))
    parsed = e.select("state_code", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "rejected").alias("reason"), F.when(F.col("event_id") % 5 != 0, F.to_date("ts").cast("string")).alias("sent_date"))
    return messages.channels_seen(parsed, e.filter("user_id % 2 = 0").select("state_code", F.lit("2023-01-01").alias("seen_on")).distinct())


@query(
    """WITH r AS (SELECT 'd' || (user_id % 9) || '.example' AS sender_domain, event_type AS subject, min(event_id) AS seq, count(*) AS n FROM events GROUP BY ALL)
SELECT sender_domain, CAST(sum(n) AS BIGINT) AS n, array_to_string((list(subject ORDER BY seq))[1:2], '|') AS subjects FROM r GROUP BY sender_domain"""
)
def unattributed_senders(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("A <b@D"), (F.col("user_id") % 9).cast("string"), F.lit(".example>")).alias("sender"), F.col("event_type").alias("subject"))
    return attribution.unattributed(e).select("sender_domain", "n", F.array_join("subjects", "|").alias("subjects"))


@query(
    """WITH p AS (SELECT conv_id, trim(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), E' \\t\\r\\n') AS a, trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'assistant'), ''), '\\s+', ' ', 'g')) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS body FROM p"""
)
def choose_body(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    part = F.struct("turn", F.when(F.col("role") == "user", "text/plain").when(F.col("role") == "assistant", "text/html").otherwise("other").alias("ctype"), F.lit(None).cast("string").alias("filename"), "text")
    # a file comes first, so that no message has one part only
    file = F.array(F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("text/plain").alias("ctype"), F.lit("a.txt").alias("filename"), F.lit("attached").alias("text")))
    parts = F.concat(file, F.array_sort(F.collect_list(part)))
    return c.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", messages.choose_body(F.col("parts")).alias("body"))


# --- the mail run ---------------------------------------------------------------------------------


def _mailbox(spark, sf_dir):
    """A mailbox by day, written from all customers' messages of twenty days; its folder."""
    import uuid

    from halyard.sources.scratch import shared_dir

    folder = f"{shared_dir(spark)}/mailbox-{uuid.uuid4().hex}"
    m = _mail(spark, sf_dir).withColumn("day", F.date_add(F.lit("2026-08-01").cast("date"), (F.col("msg_id") % 20).cast("int")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
    sent = F.concat(F.date_format("day", "d MMM yyyy"), F.lit(" 10:00:00 -0400"))
    text = F.concat(F.lit("From x\n"), line("From", F.col("sender")), line("Subject", F.col("subject")), line("Date", sent), line("List-Id", F.col("headers")), F.lit("\nby order of the governor\n"))
    m.select(text.alias("value"), "day").repartition("day").write.partitionBy("day").text(folder)
    return folder


def _mail_registry(spark, sf_dir):
    """Nations: every other is told by mail, two of three have a channel with an account, all have a domain."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    channel = F.struct(F.lit("email").alias("type"), F.concat(F.lit("https://mail.example/accounts/ACCT"), k.cast("string"), F.lit("/subscriber/new")).alias("detail"), F.lit(None).cast("string").alias("account"))
    return n.select(
        k.cast("string").alias("state_code"), F.initcap("n_name").alias("state"), F.when(k % 2 == 0, "email").otherwise("feed").alias("ingest_mode"), F.when(k % 3 != 0, channel).alias("notification_channel"),
        F.concat(F.lit(" "), F.upper(F.translate("n_name", " ", "-")), F.lit(".GOV ")).alias("expected_sender_domain"),
    )


@query(
    """WITH m AS (SELECT c_custkey AS k, n_nationkey AS n, n_name, DATE '2026-08-01' + CAST(c_custkey % 20 AS INTEGER) AS d FROM customer JOIN nation ON c_nationkey = n_nationkey), ok AS (SELECT * FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 <> 0),
dom AS (SELECT k, min(CAST(h.n_nationkey AS VARCHAR)) AS code FROM m JOIN ok h ON k % 8 = 4 AND contains('office <news@' || lower(replace(m.n_name, ' ', '-')) || '.gov>', lower(replace(h.n_name, ' ', '-')) || '.gov') GROUP BY k),
sub AS (SELECT k, min(CAST(h.n_nationkey AS VARCHAR)) AS code FROM m JOIN ok h ON k % 4 = 2 AND contains(lower('flags lowered in ' || m.n_name), lower(h.n_name)) GROUP BY k HAVING count(*) = 1),
a AS (SELECT m.k, d, coalesce(dom.code, CASE WHEN m.k % 4 = 1 AND n % 3 <> 0 THEN CAST(n AS VARCHAR) END, sub.code) AS code FROM m LEFT JOIN dom ON m.k = dom.k LEFT JOIN sub ON m.k = sub.k),
s AS (SELECT code, max(d) AS seen, max(d) FILTER (d >= DATE '2026-08-18') AS sent FROM a WHERE code IS NOT NULL AND d >= DATE '2026-08-10' GROUP BY code)
SELECT code AS state_code, strftime(sent, '%Y-%m-%d') AS sent_date, strftime(seen, '%Y-%m-%d') AS seen_on, (SELECT count(*) FROM m WHERE d >= DATE '2026-08-18') AS n_read FROM s"""
)
def mail_run(spark, sf_dir):
    """State after three mail runs: one over the mailbox from the 10th on, one without access to mail, one from the 18th on; and how many messages the last one read."""
    import uuid
    from datetime import date

    from halyard.plans.mail_run import advance
    from halyard.sources.mail import read_mailbox
    from halyard.sources.scratch import shared_dir
    from halyard.sources.versions import Store

    folder, registry = _mailbox(spark, sf_dir), _mail_registry(spark, sf_dir)
    store = Store(spark, f"{shared_dir(spark)}/mail-{uuid.uuid4().hex}")
    advance(store, read_mailbox(spark, folder, date(2026, 8, 10)), registry, "1")
    advance(store, None, registry, "2")
    late = read_mailbox(spark, folder, date(2026, 8, 18))
    last = advance(store, late, registry, "3")
    orders = last.table("orders").select("state_code", F.col("sent_date").cast("string").alias("sent_date"))
    return last.table("seen").join(orders, "state_code", "left").select("state_code", "sent_date", F.col("seen_on").cast("string").alias("seen_on"), F.lit(late.count()).alias("n_read"))


@query(
    """WITH m AS (SELECT c_custkey AS k, n_nationkey AS n, lower(replace(n_name, ' ', '-')) || '.gov' AS own, n_nationkey % 2 = 0 OR n_nationkey % 3 <> 0 AS ok, (SELECT count(*) FROM nation h WHERE (h.n_nationkey % 2 = 0 OR h.n_nationkey % 3 <> 0) AND contains(lower('flags lowered in ' || nation.n_name), lower(h.n_name))) AS named
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 20 >= 9)
SELECT CASE WHEN k % 4 = 0 THEN own ELSE 'delivery.example' END AS sender_domain, count(*) AS n FROM m WHERE k % 8 = 4 AND NOT ok OR k % 4 = 1 AND n % 3 = 0 OR k % 4 = 2 AND named = 0 GROUP BY 1"""
)
def unknown_senders_of_mail(spark, sf_dir):
    """Whose mail about flags a mail run could not attribute to any key."""
    import uuid
    from datetime import date

    from halyard.plans.mail_run import advance
    from halyard.sources.mail import read_mailbox
    from halyard.sources.scratch import shared_dir
    from halyard.sources.versions import Store

    store = Store(spark, f"{shared_dir(spark)}/mail-{uuid.uuid4().hex}")
    last = advance(store, read_mailbox(spark, _mailbox(spark, sf_dir), date(2026, 8, 10)), _mail_registry(spark, sf_dir), "1")
    return last.table("unattributed").select("sender_domain", "n")


# --- the whole: observations to one status per key -------------------------------------------------


@query(
    """WITH l AS (SELECT user_id, event_id, event_type, CAST(ts AS DATE) AS d FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1),
s AS (SELECT CASE WHEN event_type IN ('click', 'purchase') AND DATE '2024-01-30' - d BETWEEN 0 AND 2 THEN 'half' WHEN event_type = 'error' THEN 'unknown' ELSE 'full' END AS effective_status FROM l)
SELECT effective_status, count(*) AS n FROM s GROUP BY effective_status"""
)
def status_rollup(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    latest = state.latest_per_key(changes, ["user_id"], [F.col("ts"), -F.col("event_id")], ["event_id", "ts", "event_type", "changed"])
    live = F.coalesce(coverage.covers(F.to_date("ts"), F.lit(None).cast("date"), day("2024-01-30"))["verdict"], F.lit(False))
    status = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type").isin("click", "purchase") & live, "half").otherwise("full")
    states = latest.select("user_id", status.alias("status"), F.lit(None).cast("string").alias("order_title"), F.lit(False).alias("until_noon"))
    return resolve.overlay(states, resolve.statutory_observance(_calendar(spark), day("2026-01-30"))).groupBy("effective_status").agg(F.count("*").alias("n"))


_ORDER_TEXT = (
    ("Governor Cox orders flags lowered to half-staff until noon", "half", "governor", True, True),
    ("there is no current half-staff order", "full", "unknown", False, False),
    ("By order of the President flags at half-staff", "half", "president", False, False),
)


@query(
    f"SELECT o_orderkey, {case_sql('o_orderkey', tuple(x[1] for x in _ORDER_TEXT))} AS status, {case_sql('o_orderkey', tuple(x[2] for x in _ORDER_TEXT))} AS authority, o_orderkey % 3 = 0 AS until_noon, o_orderkey % 3 = 0 AS usable, "
    "CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start_date, o_orderpriority AS title FROM orders"
)
def extract_order(spark, sf_dir):
    from halyard.functions.orders import extract_order as extract

    t = F.concat(choose(F.col("o_orderkey"), tuple(x[0] for x in _ORDER_TEXT)), F.lit(", issued "), long_date(F.col("day")))
    out = orders(spark, sf_dir).select("o_orderkey", extract(t, F.lit("u"), F.col("o_orderpriority")).alias("r"))
    return out.select("o_orderkey", "r.status", "r.authority", "r.until_noon", F.col("r.usable_as_state_order").alias("usable"), F.col("r.start_date").cast("string").alias("start_date"), "r.title")


_RUN_MODES = ("email", "diff", "toggle", "feed", "archive", "index", "diff")


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS m, c_custkey % 5 AS v FROM customer)
SELECT CAST(k AS VARCHAR) AS state_code,
  CASE m WHEN 0 THEN CASE WHEN v IN (0, 1) THEN 'half' WHEN v = 2 THEN 'full' ELSE 'unknown' END WHEN 6 THEN 'unknown'
    ELSE CASE WHEN v = 4 THEN CASE WHEN k % 2 = 0 THEN 'half' ELSE 'unknown' END WHEN v < 2 THEN 'half' ELSE 'full' END END AS status,
  CASE m WHEN 0 THEN CASE WHEN v < 3 THEN 'covered' ELSE 'not_covered' END WHEN 6 THEN 'not_covered' ELSE CASE WHEN v = 4 THEN CASE WHEN k % 2 = 0 THEN 'stale' ELSE 'not_covered' END ELSE 'covered' END END AS coverage,
  CASE m WHEN 0 THEN CASE WHEN v >= 3 THEN 'subscription pending - no bulletin received from this channel yet' END WHEN 6 THEN 'no verified source for this jurisdiction' ELSE CASE WHEN v = 4 THEN 'HTTP 404' END END AS error FROM c"""
)
def status_run(spark, sf_dir):
    """A registry of all customers over seven ways to be told, resolved in one plan for 2026-08-22."""
    from halyard.plans.status_run import resolve_states

    k = F.col("c_custkey")
    v, key = k % 5, k.cast("string")
    none = F.lit(None).cast("string")
    url = F.concat(F.lit("http://h/"), key)
    cust = table(spark, sf_dir, "customer")
    registry = cust.select(
        key.alias("state_code"), choose(k, _RUN_MODES).alias("ingest_mode"), (k % 7 != 6).alias("buildable"), url.alias("press_url"), url.alias("flag_page_url"), url.alias("rss_url"), none.alias("toggle_hub_url"), none.alias("blocked_reason"),
        F.array(F.lit("http://none/")).alias("url_candidates"), F.lit(False).alias("signature_check_required"), F.lit(True).alias("dedupe_translations"),
    )
    half = v < 2
    word = F.when(half, "half").otherwise("full")
    day_text = F.when(half, "August 22, 2026").otherwise("July 1, 2026")
    head = F.concat(F.lit("Governor Lee orders flags lowered to half-staff "), day_text)
    page = choose(
        k,
        (
            F.lit(""),
            F.concat(F.lit("<p>Flag status: "), word, F.lit("-staff. Updated on August 20, 2026</p>")),
            F.concat(F.lit('<div class="flag-status"><a href="/flag-status-'), word, F.lit('.html">x</a></div>')),
            F.concat(F.lit("<item><title>"), head, F.lit("</title><link>http://art/1</link><pubDate>1 Aug 2026</pubDate></item>")),
            F.concat(F.lit('<li><a href="/o/1">'), head, F.lit("</a></li>")),
            F.concat(F.lit('<h2><a href="/o/1">'), head, F.lit("</a></h2>")),
            F.lit(""),
        ),
    )
    docs = landed_documents(cust.select(url.alias("url"), F.when(v == 4, 404).otherwise(200).alias("status"), page.alias("body"), none.alias("error")))
    articles = spark.range(0).select(F.lit("").alias("url"), F.lit("").alias("html"))
    mailed = cust.filter(half).select(key.alias("state_code"), F.lit("order").alias("title"), F.lit("2026-08-21").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("until_noon"))
    seen = cust.filter(v == 2).select(key.alias("state_code"), F.lit("2026-08-01").alias("seen_on"))
    prior = cust.filter(k % 2 == 0).select(key.alias("state_code"), F.lit("half").alias("status"))
    return resolve_states(registry, docs, articles, mailed, seen, prior, day("2026-08-22")).select("state_code", "status", "coverage", "error")


def _web_run(spark, sf_dir):
    """Arguments of a run for 2026-08-22 over all customers: feeds, archives and indexes of nine kinds, an e-mail and a failing source of each kind.

    Kind: 0 headline tells a live order; 1 headline tells no status, the article's opening does; 2 news, none about
    flags; 3 an order of the president only, where a governor's is asked for; 4 an order at the capitol only; 5 an order
    without an end, whose article gives an end that is over; 6 no items at all; 7 cannot be read; 8 an e-mail.
    """
    k = F.col("c_custkey")
    kind, key, none = k % 9, k.cast("string"), F.lit(None).cast("string")
    cust = table(spark, sf_dir, "customer")
    url, article = F.concat(F.lit("http://h/"), key), F.concat(F.lit("http://h/a"), key)
    mode = F.when(kind == 8, "email").otherwise(choose((k / 9).cast("long"), ("feed", "archive", "index")))
    registry = cust.select(
        key.alias("state_code"), F.concat(F.lit("State "), key).alias("state"), F.lit("high").alias("confidence"), mode.alias("ingest_mode"), F.lit(True).alias("buildable"), url.alias("press_url"), url.alias("flag_page_url"), url.alias("rss_url"),
        none.alias("toggle_hub_url"), none.alias("blocked_reason"), F.lit(None).cast("array<string>").alias("url_candidates"), F.lit(True).alias("signature_check_required"), F.lit(False).alias("dedupe_translations"),
    )
    head = choose(
        kind,
        (
            "Governor Lee orders flags lowered to half-staff until sunset on August 22, 2026", "Governor Lee issues a flag order for a trooper", "Governor Lee opens a new bridge over the river",
            "By order of the President flags lowered to half-staff August 22, 2026", "Governor Lee orders flags lowered to half-staff at the State Capitol August 22, 2026", "Governor Lee orders flags lowered to half-staff August 20, 2026",
            "", "unread", "",
        ),
    )
    page = F.when(kind == 6, "").when(mode == "feed", F.concat(F.lit("<item><title>"), head, F.lit("</title><link>"), article, F.lit("</link><pubDate>20 Aug 2026</pubDate></item>"))).when(mode == "archive", F.concat(F.lit('<li><a href="'), article, F.lit('">'), head, F.lit("</a></li>")))
    page = page.otherwise(F.concat(F.lit('<h2><a href="'), article, F.lit('">'), head, F.lit("</a></h2>")))
    docs = landed_documents(cust.select(url.alias("url"), F.when(kind == 7, 500).otherwise(200).alias("status"), page.alias("body"), none.alias("error")))
    body = choose(kind, ("x", "<p>Governor Lee directed that flags be lowered to half-staff from August 20, 2026 through August 23, 2026. A trooper is mourned. There is more. On Monday they return to full staff, by order of the President.</p>", "x", "Governor Lee orders this.", "x", "<p>From August 20, 2026 through August 21, 2026.</p>", "x", "x", "x"))
    articles = cust.select(article.alias("url"), body.alias("html"))
    mailed = cust.filter((kind == 8) & (k % 2 == 0)).select(key.alias("state_code"), F.lit("By mail").alias("title"), F.lit("2026-08-21").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("until_noon"))
    seen = cust.filter(kind == 8).select(key.alias("state_code"), F.lit("2026-08-01").alias("seen_on"))
    order = F.struct(F.lit("Before").alias("title"), none.alias("url"), none.alias("authority"), F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("until_noon"), none.alias("why"))
    # every other key was seen before, one in four of them with the same content
    same = text.content_hash(page)
    prior = cust.filter(k % 2 == 0).select(key.alias("state_code"), F.lit("half").alias("status"), order.alias("order"), F.when(k % 4 == 0, same).otherwise("other").alias("hash"), F.lit("2026-08-01 00:00:00").cast("timestamp").alias("last_changed_at"))
    return registry, docs, articles, mailed, seen, prior


# what the kinds of _web_run come to; a feed of other news is read and full, the other lists have no item about flags
_WEB_RUN_SQL = """WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS kind, CASE WHEN c_custkey % 9 = 8 THEN 'email' ELSE ['feed', 'archive', 'index'][c_custkey // 9 % 3 + 1] END AS mode FROM customer),
r AS (SELECT *, CASE WHEN kind IN (0, 1) THEN 'half' WHEN kind IN (3, 4, 5) THEN 'full' WHEN kind = 2 THEN CASE WHEN mode = 'feed' THEN 'full' ELSE 'unknown' END WHEN kind = 6 THEN 'unknown' WHEN kind = 7 THEN CASE WHEN k % 2 = 0 THEN 'half' ELSE 'unknown' END
  ELSE CASE WHEN k % 2 = 0 THEN 'half' ELSE 'full' END END AS status FROM c)
"""


@query(
    _WEB_RUN_SQL
    + """SELECT CAST(k AS VARCHAR) AS state_code, status, CASE WHEN kind = 7 THEN CASE WHEN k % 2 = 0 THEN 'stale' ELSE 'not_covered' END ELSE 'covered' END AS coverage,
  CASE WHEN kind = 7 THEN 'HTTP 500' WHEN kind = 6 OR kind = 2 AND mode <> 'feed' THEN 'source readable but no items parsed' END AS error,
  CASE WHEN kind = 0 THEN 'Governor Lee orders flags lowered to half-staff until sunset on August 22, 2026' WHEN kind = 1 THEN 'Governor Lee issues a flag order for a trooper' WHEN kind = 7 AND k % 2 = 0 THEN 'Before' WHEN kind = 8 AND k % 2 = 0 THEN 'By mail' END AS order_title,
  CASE WHEN kind = 1 THEN '2026-08-23' WHEN kind = 0 THEN '2026-08-22' END AS end_date, CASE WHEN kind IN (0, 1) THEN 'governor' END AS authority,
  CASE WHEN kind = 5 THEN '2026-08-21' END AS expired_on, CASE WHEN kind = 4 THEN 1 ELSE 0 END AS n_limited FROM r"""
)
def status_run_of_lists(spark, sf_dir):
    from halyard.plans.status_run import resolve_states

    out = resolve_states(*_web_run(spark, sf_dir), day("2026-08-22"))
    return out.select(
        "state_code", "status", "coverage", "error", F.col("order.title").alias("order_title"), F.col("order.end_date").cast("string").alias("end_date"), F.col("order.authority").alias("authority"),
        F.col("last_expired_order.end_date").cast("string").alias("expired_on"), F.coalesce(F.size("limited_orders"), F.lit(0)).alias("n_limited"),
    )


def _whole_run(spark, sf_dir):
    from halyard.plans.status_run import whole_run as run

    return run(*_web_run(spark, sf_dir), _calendar(spark), day("2026-08-22"), F.lit("2026-08-22 12:00:00").cast("timestamp"))


@query(
    _WEB_RUN_SQL
    + """SELECT CAST(k AS VARCHAR) AS state_code, 'State ' || k AS state, 'high' AS confidence, mode AS ingest_mode, status AS effective_status,
  CASE WHEN status = 'half' THEN CASE WHEN kind = 0 THEN 'Governor Lee orders flags lowered to half-staff until sunset on August 22, 2026' WHEN kind = 1 THEN 'Governor Lee issues a flag order for a trooper' WHEN kind = 7 THEN 'Before' ELSE 'By mail' END END AS reason,
  CASE WHEN status = 'half' THEN CASE WHEN kind IN (7, 8) THEN 'until-noon' ELSE 'full-day' END END AS scope,
  k % 2 = 0 AND kind <> 7 AND (k % 4 <> 0 OR kind = 8) AS changed,
  CASE WHEN kind = 7 THEN CASE WHEN k % 2 = 0 THEN '2026-08-01' END WHEN kind = 8 AND k % 2 <> 0 THEN NULL WHEN k % 4 = 0 AND kind <> 8 THEN '2026-08-01' ELSE '2026-08-22' END AS last_changed FROM r"""
)
def whole_run(spark, sf_dir):
    r = _whole_run(spark, sf_dir).records
    return r.select("state_code", "state", "confidence", "ingest_mode", "effective_status", "reason", "scope", "changed", F.date_format("last_changed_at", "yyyy-MM-dd").alias("last_changed"))


def _page_run(spark, sf_dir):
    """Registry and documents of pages that state a status: badges, current-status pages, keys without a source; of twelve kinds.

    Kind: 0 badge at half; 1 badge with both variants; 2 declared half, updated two days ago, with a clock; 3 half whose window is over; 4 not
    updated for too long; 5 half without, 6 with the governor's authority, where that is asked for; 7 full, without any date; 8 buildable is null,
    9 false; 10 the first URL fails, the second has a badge at full; 11 full but for one county.
    """
    k = F.col("c_custkey")
    kind, key, none = k % 12, F.concat(F.lit("p"), k.cast("string")), F.lit(None).cast("string")
    cust, url = table(spark, sf_dir, "customer"), F.concat(F.lit("http://p/"), k.cast("string"))
    registry = cust.select(
        key.alias("state_code"), key.alias("state"), F.lit("high").alias("confidence"), F.when(kind.isin(0, 1, 10), "toggle").otherwise("diff").alias("ingest_mode"), F.when(kind != 8, kind != 9).alias("buildable"), none.alias("press_url"),
        url.alias("flag_page_url"), none.alias("rss_url"), url.alias("toggle_hub_url"), F.when(kind == 9, "closed").alias("blocked_reason"), F.when(kind == 10, F.array(url, F.concat(url, F.lit("/2")))).alias("url_candidates"),
        kind.isin(5, 6).alias("signature_check_required"), F.lit(False).alias("dedupe_translations"), F.lit(None).cast("struct<type:string,detail:string,account:string>").alias("notification_channel"),
    )
    badge = lambda word: f'<div class="flag-status"><a href="/flag-status-{word}.html">x</a></div>'
    updated = " Updated on August 20, 2026"
    page = choose(
        kind,
        (
            badge("half"), badge("half") + badge("full"), "<p>Flag status: half-staff as of 10:01 AM." + updated + "</p>", "<p>Flag status: half-staff From: July 12, 2026 Until: July 18, 2026</p>", "<p>Flag status: half-staff. Updated on January 2, 2025</p>",
            "<p>Flag status: half-staff." + updated + "</p>", "<p>Flag status: half-staff. Governor Lee has ordered it." + updated + "</p>", "<p>Flag status: full-staff</p>", "x", "x", badge("full"),
            "<p>Flag status: full-staff. Summit County only by order: half-staff." + updated + "</p>",
        ),
    )
    docs = cust.select(F.when(kind == 10, F.concat(url, F.lit("/2"))).otherwise(url).alias("url"), F.lit(200).alias("status"), page.alias("body"), none.alias("error"))
    docs = docs.union(cust.filter(kind == 10).select(url, F.lit(404), none, none))
    return registry, landed_documents(docs)


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 12 AS kind, 'http://p/' || c_custkey AS url FROM customer)
SELECT 'p' || k AS state_code, CASE WHEN kind IN (0, 2, 6) THEN 'half' WHEN kind IN (3, 7, 10, 11) THEN 'full' ELSE 'unknown' END AS status, CASE kind WHEN 4 THEN 'stale' WHEN 8 THEN 'not_covered' WHEN 9 THEN 'not_covered' ELSE 'covered' END AS coverage,
  CASE kind WHEN 1 THEN 'both half and full variants present in the source' WHEN 4 THEN 'source appears frozen: newest date on page is 2025-01-02 (597d old) - not trusted' WHEN 5 THEN 'authority unproven (unknown); not claimed as state order'
    WHEN 8 THEN 'no verified source for this jurisdiction' WHEN 9 THEN 'no verified source for this jurisdiction' END AS error,
  CASE WHEN kind IN (0, 2, 3, 6, 7, 11) THEN url WHEN kind = 10 THEN url || '/2' END AS order_url, CASE WHEN kind IN (0, 2, 6) THEN 'half' WHEN kind IN (3, 7, 10, 11) THEN 'full' END AS order_status,
  CASE WHEN kind IN (0, 2, 3, 6, 7, 10, 11) THEN 'governor' END AS authority,
  CASE WHEN kind = 0 THEN 'flag-status widget (href all say half)' WHEN kind = 10 THEN 'flag-status widget (href all say full)' WHEN kind = 6 THEN 'Governor Lee has ordered' WHEN kind IN (2, 3) THEN 'declaration: ''Flag status: half-staff''' WHEN kind IN (7, 11) THEN 'declaration: ''Flag status: full-staff''' END AS evidence,
  CASE WHEN kind = 3 THEN 'window 2026-07-12..2026-07-18' END AS expired_why, CASE WHEN kind = 10 THEN url || '/2' WHEN kind NOT IN (8, 9) THEN url END AS source_url, CASE WHEN kind = 10 THEN true END AS used_alternate_url,
  CASE WHEN kind IN (2, 5, 6, 11) THEN 2 WHEN kind = 3 THEN 35 WHEN kind = 4 THEN 597 END AS age, CASE WHEN kind = 7 THEN true END AS freshness_unknown, CASE WHEN kind IN (2, 5, 6, 11) THEN '2026-08-20' WHEN kind = 3 THEN '2026-07-18' WHEN kind = 4 THEN '2025-01-02' END AS modified,
  CASE WHEN kind = 11 THEN 'Summit=half' END AS counties FROM c"""
)
def status_run_of_pages(spark, sf_dir):
    """Records of pages that state a status, with their orders, errors, ended windows and freshness."""
    from halyard.plans.status_run import resolve_states

    registry, docs = _page_run(spark, sf_dir)
    none = spark.sql("SELECT '' AS state_code, '' AS status, '' AS title, DATE '2026-01-01' AS start_date, DATE '2026-01-01' AS end_date, true AS until_noon, '' AS seen_on, '' AS url, '' AS html").limit(0)
    out = resolve_states(registry, docs, none.select("url", "html"), none.select("state_code", "title", "start_date", "end_date", "until_noon"), none.select("state_code", "seen_on"), none.select("state_code", "status"), day("2026-08-22"))
    return out.select(
        "state_code", "status", "coverage", "error", F.col("order.url").alias("order_url"), F.col("order.status").alias("order_status"), F.col("order.authority").alias("authority"), F.col("order.evidence").alias("evidence"), F.col("last_expired_order.why").alias("expired_why"),
        "source_url", "used_alternate_url", F.col("source_age_days").alias("age"), "freshness_unknown", F.col("source_last_modified").cast("string").alias("modified"),
        F.nullif(F.array_join(F.transform("county_exceptions", lambda x: F.concat(x["county"], F.lit("="), x["status"])), ","), F.lit("")).alias("counties"),
    )


def _second_run(spark, sf_dir):
    """The store after two runs, two days apart, over the sources of _web_run: in the second every fifth page says more, and every seventh cannot be read."""
    import uuid
    from datetime import date, datetime

    from halyard.plans.state_loop import Sources, advance
    from halyard.sources.scratch import shared_dir
    from halyard.sources.versions import Store

    store = Store(spark, f"{shared_dir(spark)}/loop-{uuid.uuid4().hex}")
    registry, docs, articles, mailed, seen, _ = _web_run(spark, sf_dir)
    k = F.regexp_extract("url", "[0-9]+$", 0).cast("long")
    broken = k % 7 == 3
    later = docs.select("url", F.when(~broken, F.when(k % 5 == 1, F.concat("html", F.lit("<p>more</p>"))).otherwise(F.col("html"))).alias("html"), F.when(broken, "HTTP 500").otherwise(F.col("error")).alias("error"))
    advance(store, Sources(registry, docs, articles, mailed, seen, _calendar(spark)), "2026-08-22T12:00", date(2026, 8, 22), datetime(2026, 8, 22, 12))
    advance(store, Sources(registry, later, articles, mailed, seen, _calendar(spark)), "2026-08-24T12:00", date(2026, 8, 24), datetime(2026, 8, 24, 12))
    return store


# first and second: the status in each run; failed and changed: in the second
_LOOP_SQL = (
    _WEB_RUN_SQL.rstrip()
    + """,
s AS (SELECT k, kind, mode, CASE WHEN kind = 7 THEN 'unknown' ELSE status END AS first, kind = 7 OR kind <> 8 AND k % 7 = 3 AS failed, kind NOT IN (7, 8) AND k % 7 <> 3 AND k % 5 = 1 AS changed FROM r),
t AS (SELECT *, CASE WHEN failed THEN first WHEN kind IN (0, 1, 8) THEN 'full' ELSE first END AS second FROM s)
"""
)


@query(
    _LOOP_SQL
    + """SELECT CAST(k AS VARCHAR) AS state_code, second AS status, CASE WHEN kind = 7 THEN 'not_covered' WHEN failed THEN 'stale' ELSE 'covered' END AS coverage, changed,
  CASE WHEN kind = 7 OR kind = 8 AND k % 2 <> 0 THEN NULL WHEN changed THEN '2026-08-24' ELSE '2026-08-22' END AS last_changed, (SELECT count(*) FROM t WHERE changed) AS n_parsed FROM t"""
)
def state_loop(spark, sf_dir):
    """Two runs through a folder: verdicts of the second day, what changed between them, and how many pages the second had to parse."""
    from halyard.plans.state_loop import parsed_count

    last = _second_run(spark, sf_dir).latest()
    return last.table("records").select("state_code", "status", "coverage", "changed", F.date_format("last_changed_at", "yyyy-MM-dd").alias("last_changed"), F.lit(parsed_count(last)).alias("n_parsed"))


@query(_LOOP_SQL + """SELECT CAST(k AS VARCHAR) AS key, '2026-08-24 12:00:00' AS at, second AS value, CAST(NULL AS VARCHAR) AS reason, 2 AS version FROM t WHERE changed""")
def change_log(spark, sf_dir):
    """The log after two runs, of which the second was repeated: only what changed, once."""
    from datetime import date, datetime

    from halyard.plans.state_loop import LOG, Sources, advance

    store = _second_run(spark, sf_dir)
    registry, docs, articles, mailed, seen, _ = _web_run(spark, sf_dir)
    advance(store, Sources(registry, docs, articles, mailed, seen, _calendar(spark)), "2026-08-24T12:00", date(2026, 8, 24), datetime(2026, 8, 24, 12))
    return store.log(LOG).select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "value", "reason", "version")


_CHANGED_SQL = "k % 2 = 0 AND kind <> 7 AND (k % 4 <> 0 OR kind = 8)"


@query(_WEB_RUN_SQL + f"SELECT array_to_string(list_sort(list(CAST(k AS VARCHAR)) FILTER (status = 'half')), ' ') AS half, array_to_string(list_sort(list(CAST(k AS VARCHAR)) FILTER ({_CHANGED_SQL})), ' ') AS changed FROM r")
def half_and_changed_codes(spark, sf_dir):
    return _whole_run(spark, sf_dir).codes.select(F.array_join("half", " ").alias("half"), F.array_join("changed", " ").alias("changed"))


@query(_WEB_RUN_SQL + f"""SELECT CAST(k AS VARCHAR) AS key, '{{"tag":"flag-' || k || '","title":"' || CASE status WHEN 'half' THEN 'to half-staff' ELSE 'back to full staff' END || '","status":"' || status || '"}}' AS payload FROM r WHERE {_CHANGED_SQL}""")
def run_notices(spark, sf_dir):
    return _whole_run(spark, sf_dir).notices.select("key", "payload")


@query(_WEB_RUN_SQL + """SELECT '2026-08-22' AS date, count(*) AS n_states, min(CAST(k AS VARCHAR)) AS first_code, count(*) FILTER (kind <> 7) AS covered FROM r""")
def status_document(spark, sf_dir):
    """The published document, all its parts read again as JSON."""
    doc = _whole_run(spark, sf_dir).document("2026-08-22")
    at = lambda path: F.get_json_object("document", path)
    parts = doc.select(at("$.date").alias("date"), F.json_object_keys(at("$.states")).alias("keys"), at("$.meta.covered").cast("long").alias("covered"))
    return parts.agg(F.min("date").alias("date"), F.sum(F.size("keys")).alias("n_states"), F.min(F.get("keys", F.lit(0))).alias("first_code"), F.min("covered").alias("covered"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def rows_of_a_key(spark, sf_dir):
    return resolve.of_keys(table(spark, sf_dir, "customer"), "c_mktsegment", "building").select("c_custkey", "c_mktsegment")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS buildable, count(*) AS total FROM orders")
def buildable_count(spark, sf_dir):
    status = F.col("o_orderstatus")
    return resolve.buildable_count(table(spark, sf_dir, "orders").select(F.when(status != "P", status == "F").alias("buildable")))


@query("""SELECT o_orderkey, sha256('{"by":' || CASE WHEN o_orderkey % 3 = 0 THEN '" "' ELSE 'null' END || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","title":"' || o_orderpriority || '"}')[1:16] AS hash FROM orders""")
def order_hash(spark, sf_dir):
    """Null fields count, and an address in angle brackets is no content."""
    order = F.struct(F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 3 == 0, "<a@b.org>").alias("by"), F.col("day"))
    return orders(spark, sf_dir).select("o_orderkey", text.order_hash(order, "struct<title:string,by:string,day:date>").alias("hash"))


@query(
    """WITH u AS (SELECT DISTINCT user_id % 40 AS u FROM events) SELECT 'page ' || u AS page, CASE WHEN u % 4 = 3 THEN 'remembered order' WHEN u % 2 = 0 THEN 'President orders flags lowered to half-staff ' || u ELSE 'Feed: flags lowered to half-staff ' || u END AS title FROM u"""
)
def proclamation_items(spark, sf_dir):
    """Index pages, feeds where a page has no index items, and pages whose items an earlier run has parsed."""
    u = F.col("u")
    pages = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("u")).distinct()
    index = F.concat(F.lit('<h2><a href="/o">President orders flags lowered to half-staff '), u.cast("string"), F.lit("</a></h2>"))
    feed = F.concat(F.lit("<item><title>Other news</title></item><item><title>Feed: flags lowered to half-staff "), u.cast("string"), F.lit("</title><link>http://x/</link></item>"))
    pages = pages.select("u", F.lit(parse.PROCLAMATION).alias("kind"), F.lit("http://h/").alias("url"), F.lit(False).alias("dedupe"), F.when(u % 2 == 0, index).otherwise(feed).alias("html"))
    pages = pages.withColumn("key", parse.parse_key(F.col("kind"), F.col("url"), F.col("dedupe"), F.col("html")))
    remembered = F.array(F.named_struct(F.lit("title"), F.lit("remembered order")))
    cache = pages.filter(u % 4 == 3).select("key", F.lit(parse.VERSION).alias("version"), remembered.alias("items"))
    cache = cache.union(pages.filter(u % 4 == 2).select("key", F.lit(parse.VERSION - 1).alias("version"), remembered.alias("items")))  # of an older parser, so of no use
    known, lacking = parse.known_and_new(pages, cache)
    title = F.get("items", 0)["title"].alias("title")
    found = known.select("key", title).union(parse.parsed(lacking, "key").select("key", title))
    return pages.join(found, "key").select(F.concat(F.lit("page "), u.cast("string")).alias("page"), "title")


@query(
    """WITH h AS (SELECT event_id, user_id, sha256('Status ' || event_type || ' at ')[1:16] AS f FROM events), l AS (SELECT user_id, f, lag(f) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM h)
SELECT user_id, i, f AS fingerprint, p IS NOT NULL AND p <> f AS changed, p IS NULL AS first_seen FROM l"""
)
def observed_pages(spark, sf_dir):
    pages = _status_pages(spark, sf_dir)
    key = lambda i: F.struct("user_id", i.alias("i")).alias("key")
    before = resolve.observed_pages(pages.select(key(F.col("i") + 1), "html"), None, "key").select("key", "fingerprint")
    return resolve.observed_pages(pages.select(key(F.col("i")), "html"), before, "key").select("key.user_id", "key.i", "fingerprint", "changed", "first_seen")


def _status_pages(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    page = F.concat(F.lit("<p>Status "), F.col("event_type"), F.lit(" at 10:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(" AM</p>"))
    return e.select("user_id", "i", page.alias("html"))


@query(f"SELECT event_id, {case_sql('event_id', _ERRORS)} AS error FROM events WHERE event_id % 7 BETWEEN 1 AND 5 AND event_id % 4 <> 2 OR event_id % 4 = 3")
def failing_sources(spark, sf_dir):
    k = F.col("event_id")
    return resolve.failing_sources(table(spark, sf_dir, "events").select("event_id", choose(k, _COVERAGE).alias("coverage"), choose(k, _ERRORS).alias("error"))).select("event_id", "error")


@query(
    """WITH r AS (SELECT CASE WHEN c_custkey % 4 = 3 OR c_custkey % 8 = 0 THEN 'not flag-related' WHEN c_custkey % 4 = 2 AND n > 1 THEN 'subject names ' || n || ' states - ambiguous' END AS reason
FROM customer JOIN (SELECT a.n_nationkey, count(*) AS n FROM nation a JOIN nation b ON contains(lower(a.n_name), lower(b.n_name)) GROUP BY 1) ON c_nationkey = n_nationkey)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason"""
)
def reject_reasons(spark, sf_dir):
    return messages.reject_reasons(messages.parse_messages(_mail(spark, sf_dir), *_dimensions(spark, sf_dir)))


@query("SELECT 'https://s' || (c_custkey % 4) || '.org/' || CASE WHEN c_custkey % 3 = 0 THEN 'private/' ELSE 'open/' END || c_custkey AS url, NOT (c_custkey % 4 = 0 AND c_custkey % 3 = 0) AS allowed FROM customer")
def access_policy(spark, sf_dir):
    from halyard.sources.tables import access_policy as policy

    k = F.col("c_custkey")
    urls = table(spark, sf_dir, "customer").select(F.concat(F.lit("https://s"), (k % 4).cast("string"), F.lit(".org/"), F.when(k % 3 == 0, "private/").otherwise("open/"), k.cast("string")).alias("url"))
    n = F.col("id")
    robots = spark.range(3).select(F.concat(F.lit("https://s"), n.cast("string"), F.lit(".org")).alias("site"), F.when(n == 1, 403).otherwise(200).alias("status"), F.when(n == 2, "text/html").otherwise("text/plain").alias("content_type"), F.lit("User-agent: *\nDisallow: /private/").alias("body"))
    return policy(urls, robots)
