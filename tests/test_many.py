"""Very many patterns, and matches with their left context, against plain scans."""

import random
import re

from pyspark.sql import functions as F

from halyard.functions import rules
from halyard.operators import attribution, containment
from halyard.plans.queries import QUERIES
from places import DATA


def test_contained_patterns_are_those_of_a_scan(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcde.-é") for _ in range(n))
    patterns = sorted({word(rng.choice([1, 2, 3, 4, 5, 6, 9])) for _ in range(400)} | {"a", "ab.cd"}) + ["ab.cd", "", None]
    texts = [word(rng.randrange(0, 40)) for _ in range(300)] + ["", None, "ab.cd"]
    table = spark.createDataFrame(list(enumerate(patterns)), "i int, p string")
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = sorted((k, i) for k, t in enumerate(texts) for i, p in enumerate(patterns) if t is not None and p and p in t)
    for most in (1_000_000, 0):
        assert sorted((r.k, r.i) for r in containment.contained(rows, "k", "t", table, "p", most_broadcast=most).collect()) == want
    assert containment.contained(rows, "k", "t", table.limit(0), "p").count() == 0 == containment.contained(rows.limit(0), "k", "t", table, "p").count()


def test_attribution_by_index_over_a_hundred_thousand_patterns(spark):
    """The same rows as the scan gives, which is run over fewer messages and a tenth of the patterns."""
    n = F.col("id")
    code = n.cast("string").alias("code")
    domain = F.concat(F.lit("news"), n.cast("string"), F.lit(".state.gov"))

    def dimensions(size):
        r = spark.range(size)
        return r.select(n.alias("priority"), domain.alias("domain"), code), r.select(n.alias("priority"), F.concat(F.lit("acct-"), n.cast("string")).alias("slug"), code), r.select(code, F.concat(F.lit("Land "), n.cast("string"), F.lit("!")).alias("name"))

    k = F.col("id") * 37 % 9973
    sender = F.when(F.col("id") % 3 == 0, F.concat(F.lit("A <x@News"), k.cast("string"), F.lit(".STATE.gov>"))).otherwise("list@x.example")
    headers = F.when(F.col("id") % 3 == 1, F.concat(F.lit("<acct-"), k.cast("string"), F.lit(".list>")))
    subject = F.when(F.col("id") % 3 == 2, F.concat(F.lit("Flags in land "), k.cast("string"), F.lit("!"), F.when(F.col("id") % 2 == 0, " and Land 5!").otherwise("")))
    mail = spark.range(600).select(F.col("id").alias("msg_id"), sender.alias("sender"), headers.alias("headers"), subject.alias("subject"))
    rows = lambda df: sorted((r.msg_id, r.code, r.how) for r in df.select("msg_id", "code", "how").collect())
    few = dimensions(10_000)
    assert rows(attribution.attributed_by_index(mail.filter("msg_id < 60"), *few)) == rows(attribution.attributed(mail.filter("msg_id < 60"), *few))
    many = rows(attribution.attributed_by_index(mail, *dimensions(100_000)))
    assert len(many) == 600 and sum(c is not None for _, c, _ in many) > 400 and sum("ambiguous" in h for *_, h in many) > 80


def test_matches_outside_prose_are_those_of_a_scan(spark):
    rng = random.Random(6)
    bits = ["flags at half-staff", "Flags to be flown at Full Staff", "flag is to be flown at half mast", "policy", "in memory of", ".", "x" * 30, " ", "FLAGS at full-staff", "newsroom ", "\n", "ü"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["", "flags at half-staff" * 50]
    for pattern in rules.DECLARATIONS[rules.GUARDED_FROM :]:

        def plain(t, pattern=pattern):
            for m in re.finditer(pattern, t, re.IGNORECASE):
                if not re.search(rules.PROSE_BEFORE, t[max(0, m.start() - rules.PROSE_CHARS) : m.start()], re.IGNORECASE):
                    return m[0]
            return None

        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        got = df.select("i", rules.outside(F.col("t"), "(?iU)" + pattern, "(?iU)" + rules.PROSE_BEFORE, rules.PROSE_CHARS).alias("m")).collect()
        assert {r.i: r.m for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_declarations_need_no_python(spark):
    plan = QUERIES["every_declaration"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
