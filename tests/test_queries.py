"""Every query of the status engine against its SQL on the smallest tables."""

from collections import Counter
from datetime import timedelta

import pytest

from places import DATA
from halyard.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, same_rows, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    if name in ORACLES:
        same_rows(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_covered_days_of_all_orders(spark, duck):
    rows = duck.sql("SELECT o_orderkey, CAST(o_orderdate AS DATE) FROM orders").fetchall()
    days = {d for _, d in rows}
    want = Counter(str(d + timedelta(i)) for k, d in rows for i in range(k % 40 + 1) if d + timedelta(i) in days)
    assert {r.day: r.n for r in QUERIES["covered_days"](spark, f"{DATA}/sf0.001").collect()} == want


def test_latest_orders_of_all_mail_choose_between_paths(spark, duck):
    got = {r.state_code: r.msg_id for r in QUERIES["latest_orders"](spark, f"{DATA}/sf0.001").collect()}
    assert {0, 1, 2} == {i % 4 for i in got.values()} and all(i % 8 != 0 for i in got.values())
    nations = dict(duck.sql("SELECT c_custkey, CAST(c_nationkey AS VARCHAR) FROM customer").fetchall())
    assert all(nations[i] == code for code, i in got.items())


def test_pages_of_all_years_and_events(spark, duck):
    count = lambda sql: duck.sql(sql).fetchall()[0][0]
    pages = QUERIES["page_last_modified"](spark, f"{DATA}/sf0.001")
    assert pages.count() == count("SELECT count(*) FROM orders")
    assert pages.filter("modified IS NULL").count() == count("SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0 AND year(o_orderdate) < 2000") > 0
    seen = QUERIES["observed_pages"](spark, f"{DATA}/sf0.001")
    assert seen.count() == count("SELECT count(*) FROM events") and seen.filter("first_seen").count() == count("SELECT count(DISTINCT user_id) FROM events")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
