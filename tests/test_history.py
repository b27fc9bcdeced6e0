"""Intervals of validity, and resolution over a stream against the same over a table."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from halyard.operators import history
from halyard.streaming import resolution


def test_intervals_and_points(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("a", 7, None), ("a", 9, None), ("b", 3, "x"), (None, 1, "n"), ("c", None, "x")], "k string, at int, v string")
    got = sorted(map(tuple, history.validity(log, "k", "at", ["v"]).collect()), key=repr)
    assert got == sorted([("a", "x", 1, 5), ("a", "z", 5, 7), ("a", None, 7, None), ("b", "x", 3, None), (None, "n", 1, None)], key=repr)
    points = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 6, 3), ("a", 8, 4), ("b", 9, 5), ("d", 1, 6), (None, 4, 7), ("a", 6, 3)], "k string, at int, i int")
    assert sorted((r.i, r.v) for r in history.value_at(points, log.filter("v IS NOT NULL"), "k", "at", ["v"]).collect() if r.v) == [(2, "x"), (3, "z"), (3, "z"), (4, "z"), (5, "x"), (7, "n")]
    assert history.value_at(points, log, "k", "at", ["v"]).count() == 8
    assert history.validity(log.limit(0), "k", "at", ["v"]).count() == 0


def observations(seed):
    rng = random.Random(seed)
    out, origin = [], date(2026, 1, 1)
    for k in range(12):
        at = datetime(2026, 1, 1) + timedelta(hours=rng.randrange(24))
        while at < datetime(2026, 9, 1):
            day = at.date()
            some = lambda *near: rng.choice([None, *(day + timedelta(n) for n in near)])
            status = rng.choice(["half", "half", "full", "unknown", None])
            if rng.random() < 0.25:
                out.append((f"k{k}", at, rng.choice(["HTTP 500", "timeout"]), None, None, None, None, None, None))
            else:
                out.append((f"k{k}", at, None, rng.choice("pqr"), status, some(-3, 0, 4), some(-1, 2, 9), some(-25, -19, -1, 0), some(-170, -3)))
            at += timedelta(hours=rng.choice([5, 30, 24 * 9, 24 * 40]))
    assert origin
    return sorted(out, key=lambda r: r[1])


def test_stream_turns_as_the_table_does_over_restarts(spark, tmp_path):
    rows = observations(3)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    third = len(rows) // 3
    end = [("end", datetime(2027, 6, 1), None, "p", "full", None, None, None, None)]  # moves event time on
    late = [("k0", datetime(2026, 1, 1), None, "late", "half", None, None, None, None)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in (rows[:third], rows[third : 2 * third] + late, rows[2 * third :], end):
            spark.createDataFrame(part, resolution.OBSERVATION).coalesce(1).write.mode("append").parquet(src)
            stream = resolution.resolution_stream(spark.readStream.schema(resolution.OBSERVATION).parquet(src))

            def write(batch, batch_id):
                batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

            stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    turns = spark.read.parquet(out).filter("key <> 'end'").drop("batch").cache()
    assert turns.filter("at > TIMESTAMP'2026-09-20'").count() > 0  # by timers alone
    table = spark.createDataFrame(rows, resolution.OBSERVATION).cache()
    days = [date(2026, 1, 2) + timedelta(i) for i in (0, 1, 3, 17, 40, 77, 120, 121, 122, 150, 190, 243, 300, 430)]
    points = spark.createDataFrame([(f"k{k}", datetime(d.year, d.month, d.day, 23, 59, 59), d) for k in range(12) for d in days], "key string, at timestamp, d date")
    got = {(r.key, r.d): (r.status, r.coverage) for r in history.value_at(points, turns, "key", "at", ["status", "coverage"]).collect()}
    for d in days:
        for r in resolution.verdicts_on(table, F.lit(d)).collect():
            assert got[r.key, d] == (r.status, r.coverage), (r.key, d)
    good = [(r[0], r[1], r[3]) for r in rows if r[2] is None]
    before, changes = {}, 0
    for key, _, told in good:
        changes += key in before and before[key] != told
        before[key] = told
    assert turns.filter("changed").count() == changes


def test_verdicts_and_turns_agree():
    rng = random.Random(8)
    for _ in range(3000):
        day = date(2026, 5, 5)
        near = lambda: rng.choice([None, day + timedelta(rng.randrange(-200, 30))])
        facts = {"hash": "h", "status": rng.choice(["half", "full", None]), "start_date": near(), "end_date": near(), "item_date": near(), "modified": near()}
        turn, now = resolution.next_turn(facts, day), resolution.verdict(facts, day)
        for i in range(1, 260):
            d = day + timedelta(i)
            if turn and d >= turn:
                break
            assert resolution.verdict(facts, d) == now


class Handle:
    """The state of one key, in memory."""

    def __init__(self):
        self.values, self.timers, self.updates = {}, [], 0

    def getValueState(self, name, schema):
        handle = self

        class Value:
            exists = lambda self: name in handle.values
            get = lambda self: handle.values.get(name)

            def update(self, value):
                handle.updates += 1
                handle.values[name] = value

        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_key_of_a_stream_costs_little():
    import time

    from pyspark.sql import Row

    fields = [f.split()[0] for f in resolution.OBSERVATION.split(", ")]
    rows = [Row(*fields, "local_at")(*r, r[1]) for r in observations(5)]
    began, turns = time.process_time(), 0
    for i in range(300):
        keeper, handle = resolution.Keeper(), Handle()
        keeper.init(handle)
        turns += len(list(keeper.handleInputRows((f"k{i % 12}",), iter([r for r in rows if r.key == f"k{i % 12}"]), None)))
    assert turns > 300 and (time.process_time() - began) / 300 < 0.004  # 0.011 s a key with a frame for each


def test_a_timer_writes_only_what_it_turns():
    from pyspark.sql import Row

    at, day = datetime(2026, 8, 20, 9), date(2026, 8, 20)
    row = Row(*[f.split()[0] for f in resolution.OBSERVATION.split(", ")], "local_at")
    keeper, handle = resolution.Keeper(), Handle()
    keeper.init(handle)
    # two of one time: the failure comes first, the greater fact last
    told = [row("k", at, None, "h", "half", day, date(2026, 8, 22), day, None, at), row("k", at, "HTTP 500", None, None, None, None, None, None, at), row("k", at, None, "h", "full", day, None, day, None, at)]
    out = list(keeper.handleInputRows(("k",), iter(told), None))
    assert [(r.at, r.status, r.coverage) for r in out] == [(at, "half", "covered")] and handle.timers == [1787443200000]
    before, handle.updates = dict(handle.values), 0

    class Now:
        getCurrentWatermarkInMs = lambda self: 1787443200000

    out = list(keeper.handleExpiredTimer(("k",), Now(), None))
    assert [(r.at, r.status, r.changed) for r in out] == [(datetime(2026, 8, 23), "full", False)] and handle.updates == 1
    assert {n: v for n, v in handle.values.items() if n != "shown"} == {n: v for n, v in before.items() if n != "shown"}
