"""Resolution over a stream of observations: verdicts that turn when a source says something else, and when a day comes.

An observation is what a parse told of a key at a time (operators.parse), or an error. State, per key: what the
source said last, its stamps, and what is shown. Timers in event time fire on the days on which rules about days turn a
verdict: an order begins, its grace or its window ends, it gets too old to be looked at, a page too old to be trusted.
verdicts_on() is the same over a table, for any day.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from halyard.functions.rules import FULL, HALF, UNKNOWN
from halyard.operators.coverage import FROZEN_DAYS, GRACE_DAYS, LOOKBACK_DAYS, covers, freshness, recent

OBSERVATION = "key string, at timestamp, error string, hash string, status string, start_date date, end_date date, item_date date, modified date"
FACTS = ("hash", "status", "start_date", "end_date", "item_date", "modified")
OUTPUT = "key string, at timestamp, status string, coverage string, error string, changed boolean, last_changed_at timestamp"
LOCAL = OUTPUT.replace("timestamp", "timestamp_ntz")  # as the processor gives it: times of the session's zone
TURN = Row(*[f.split()[0] for f in OUTPUT.split(", ")])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def verdict(facts: dict, day: date) -> tuple[str, str]:
    """(status, coverage) of a source that said this, on a day; the rules of operators.coverage."""
    if facts["modified"] and (day - facts["modified"]).days > FROZEN_DAYS:
        return UNKNOWN, "stale"
    if facts["status"] != HALF:
        return facts["status"] or UNKNOWN, "covered"
    start, end, item = facts["start_date"] or facts["item_date"], facts["end_date"], facts["item_date"]
    if item and (day - item).days > LOOKBACK_DAYS:
        return FULL, "covered"
    if end:
        live = (not start or start <= day) and day <= end
    else:
        live = bool(start) and 0 <= (day - start).days <= GRACE_DAYS
    return (HALF if live else FULL), "covered"


def next_turn(facts: dict, day: date) -> date | None:
    """The first day after this one on which the verdict may be another."""
    start = facts["start_date"] or facts["item_date"]
    turns = [start, start and start + timedelta(GRACE_DAYS + 1), facts["end_date"] and facts["end_date"] + timedelta(1)]
    turns += [facts[f] and facts[f] + timedelta(n + 1) for f, n in (("item_date", LOOKBACK_DAYS), ("modified", FROZEN_DAYS))]
    return min((t for t in turns if t and t > day), default=None)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """By time; at one time failures first, then the greater facts last, as verdicts_on() has it."""
    out = sorted(rows, key=lambda r: r.local_at)
    if any(a.local_at == b.local_at for a, b in zip(out, out[1:], strict=False)):
        out.sort(key=lambda r: (r.local_at, r.error is None, *((r[f] is not None, r[f]) if r[f] is not None else (False,) for f in (*FACTS[1:], "hash"))))
    return out


class Keeper(StatefulProcessor):
    """Keeps a key's facts, stamps and what is shown, and emits a row whenever what is shown turns, or what the source says."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "hash string, status string, start_date date, end_date date, item_date date, modified date")
        self.stamps = handle.getValueState("stamps", "seen_at timestamp, last_changed_at timestamp, error string")
        self.shown = handle.getValueState("shown", "status string, coverage string, day date")

    def _load(self) -> tuple[dict | None, dict, dict]:
        facts, stamps, shown = self.facts.get(), self.stamps.get(), self.shown.get()  # None where there is none
        facts = facts and dict(zip(FACTS, facts, strict=True))
        stamps = dict(zip(("seen_at", "last_changed_at", "error"), stamps or (None, None, None), strict=True))
        shown = dict(zip(("status", "coverage", "day"), shown or (None, None, None), strict=True))
        return facts, stamps, shown

    def _turns(self, key: str, facts: dict | None, stamps: dict, shown: dict, until: datetime) -> list[tuple]:
        """Rows for the days up to this time on which the verdict turned; a source that fails keeps what is shown."""
        out = []
        day = shown["day"]
        while facts and not stamps["error"] and day and (day := next_turn(facts, day)) and day <= until.date():
            now = verdict(facts, day)
            shown["day"] = day
            if now != (shown["status"], shown["coverage"]):
                shown["status"], shown["coverage"] = now
                out.append((key, datetime(day.year, day.month, day.day), *now, None, False, stamps["last_changed_at"]))
        return out

    def _save(self, facts: dict | None, stamps: dict, shown: dict) -> None:
        if facts:
            self.facts.update(tuple(facts[f] for f in FACTS))
        self.stamps.update(tuple(stamps.values()))
        self.shown.update(tuple(shown.values()))
        self._wait(facts, stamps, shown)

    def _wait(self, facts: dict | None, stamps: dict, shown: dict) -> None:
        """Set the timer for the next day on which the verdict may turn, if there is one."""
        due = facts and not stamps["error"] and next_turn(facts, shown["day"])
        if due:
            self.handle.registerTimer(int((datetime(due.year, due.month, due.day) - datetime(1970, 1, 1)).total_seconds() * 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        facts, stamps, shown = self._load()
        out = []
        for r in _in_order(rows):
            at = r.local_at
            if stamps["seen_at"] and at < stamps["seen_at"]:
                continue  # the key is known to a later time
            out += self._turns(key[0], facts, stamps, shown, at)
            error, changed = r.error, False
            if error is None:
                told = {f: r[f] for f in FACTS}
                changed = facts is not None and facts["hash"] != told["hash"]
                if facts is None or changed:
                    stamps["last_changed_at"] = at
                facts = told
                now = verdict(facts, at.date())
            else:
                now = (shown["status"] or UNKNOWN, "stale" if facts else "not_covered")
            turned = now != (shown["status"], shown["coverage"]) or error != stamps["error"]
            stamps["seen_at"], stamps["error"] = at, error
            shown.update(status=now[0], coverage=now[1], day=at.date())
            if out and out[-1][1] == at:  # one row a time: what is shown at its end
                changed |= out.pop()[5]
                turned = True
            if turned or changed:
                out.append((key[0], at, *now, error, changed, stamps["last_changed_at"]))
        self._save(facts, stamps, shown)
        yield from (TURN(*row) for row in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        facts, stamps, shown = self._load()
        day = shown["day"]
        # all turns that event time has passed, since a timer that is set for such a day now may wait for the next batch
        out = self._turns(key[0], facts, stamps, shown, datetime(1970, 1, 1) + timedelta(milliseconds=timerValues.getCurrentWatermarkInMs()))
        if shown["day"] != day:
            self.shown.update(tuple(shown.values()))  # a timer tells no facts and no stamps
        self._wait(facts, stamps, shown)
        yield from (TURN(*row) for row in out)

    def close(self) -> None:
        pass


def resolution_stream(observations: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Rows (OUTPUT) for each turn of a key's status, coverage, error or content, from a stream of observations.

    Turns by the day come out when event time has passed them by `delay`. Observations that come later than
    that, or after a later one of their key, are ignored. There is one row for a key and a time, unless later
    batches tell of the same time again. A batch's observations of one key are held at once, which the source's
    maxFilesPerTrigger or maxBytesPerTrigger bounds. Turns on the session's RocksDB state store, which timers need.
    """
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = observations.select(*[f.split()[0] for f in OBSERVATION.split(", ")]).withWatermark("at", delay).withColumn("local_at", F.col("at").cast("timestamp_ntz"))
    # rows, not frames: most keys have a few rows in a batch, and frames cost milliseconds a key
    turns = rows.groupBy("key").transformWithState(Keeper(), LOCAL, "Update", "EventTime")
    return turns.select(*[F.col(name).cast(kind).alias(name) for name, kind in (f.split() for f in OUTPUT.split(", "))])


def verdicts_on(observations: DataFrame, day: Column) -> DataFrame:
    """key, status, coverage on a day, from all observations (a table) of that day and before.

    A source that fails keeps the status of the day on which it began to fail. Of two observations of one
    time the greater counts.
    """
    seen = observations.filter((F.col("at").cast("date") <= day) & F.col("key").isNotNull())
    fact = F.struct(*[c for c in FACTS if c != "hash"])
    last = seen.groupBy("key").agg(
        F.max_by(F.when(F.col("error").isNull(), fact), F.when(F.col("error").isNull(), F.struct("at", fact.alias("f")))).alias("f"), F.max(F.when(F.col("error").isNull(), F.col("at"))).alias("good_at"), F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.col("at")))).alias("errors")
    )
    failed = F.get(F.filter("errors", lambda e: F.col("good_at").isNull() | (e > F.col("good_at"))), 0)
    rows = last.withColumn("failed", failed).withColumn("on", F.least(day, F.col("failed").cast("date")))
    start = F.coalesce("f.start_date", "f.item_date")
    live = F.coalesce(covers(start, F.col("f.end_date"), F.col("on"))["verdict"], F.lit(False)) & recent(F.col("f.item_date"), F.col("on"))
    frozen = freshness(F.col("f.modified"), F.col("on"))["frozen"]
    status = F.when(F.col("f").isNull() | frozen, UNKNOWN).when(F.col("f.status") == HALF, F.when(live, HALF).otherwise(FULL)).otherwise(F.coalesce("f.status", F.lit(UNKNOWN)))
    coverage = F.when(F.col("f").isNull(), "not_covered").when(F.col("failed").isNotNull() | frozen, "stale").otherwise("covered")
    return rows.select("key", status.alias("status"), coverage.alias("coverage"))
