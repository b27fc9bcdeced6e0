"""URL filters by host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into the expressions that some rule could equal: suffixes of the
host at its dots, prefixes of the path behind its slashes (and, where rules end within a segment, prefixes
of the next segment of just those lengths). Expressions meet rules by an equi-join on a short prefix of
their SHA-256; a pair counts if the full digests agree. The longest rule decides. DataFrame functions only.

How deep to expand follows from the rules: deeper expressions could equal none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
PREFIX_DIGITS = 8  # hex digits of the short hash, 32 bits
MOST_BROADCAST = 200_000  # rules; a row has about 150 bytes
SALTS = 16  # parts of a hot expression where the rules are too many to broadcast

# The rules of the query.
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; empty without `://` or url."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Depth:
    """How deep expressions must go to reach every rule: labels of hosts, slashes of paths, lengths of what follows the last slash."""

    labels: int
    slashes: int
    tails: tuple[int, ...]

    @classmethod
    def of(cls, rules: DataFrame) -> Depth:
        labels = F.size(F.split("host", "\\."))
        slashes = F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit("")))
        tail = F.char_length(F.element_at(F.split("path", "/"), -1))
        r = rules.agg(F.max(labels).alias("labels"), F.max(slashes).alias("slashes"), F.array_sort(F.collect_set(F.when(tail > 0, tail))).alias("tails")).first()
        return cls(r["labels"] or 0, r["slashes"] or 0, tuple(r["tails"]))


def host_suffixes(host: Column, labels: int) -> Column:
    """The host and what follows each of its dots, as far as they have no more than this many labels."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))


def path_prefixes(path: Column, slashes: int, tails: tuple[int, ...]) -> Column:
    """The empty path and each prefix with no more than this many slashes that ends in one, or has a tail of one of these lengths behind it."""
    parts = F.split(path, "/", slashes + 2)  # the last part keeps further slashes
    at_slash = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(slashes))), lambda k: F.when(k > 0, F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))).otherwise(""))
    if not tails:
        return at_slash
    segment = lambda k: F.substring_index(F.get(parts, k), "/", 1)
    longer = F.transform(at_slash, lambda p, k: F.transform(F.filter(F.array(*map(F.lit, tails)), lambda t: t <= F.char_length(segment(k))), lambda t: F.concat(p, F.substring(segment(k), F.lit(1), t))))
    return F.concat(at_slash, F.flatten(longer))


def expressions(host: Column, path: Column, depth: Depth) -> Column:
    """array of struct(host, path): all that a rule of this depth could be to fit."""
    paths = path_prefixes(path, depth.slashes, depth.tails)
    return F.flatten(F.transform(host_suffixes(host, depth.labels), lambda h: F.transform(paths, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\0", host, path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) as they are matched: hosts in lower case, one row a rule; where rules contradict each other, block stays."""
    clean = rules.filter("host IS NOT NULL AND verdict IN ('allow', 'block')").select(host_of(F.concat(F.lit("://"), "host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    return clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts last


def best_rules(targets: DataFrame, rules: DataFrame, prefix_digits: int = PREFIX_DIGITS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(host, path, rule, verdict) of the targets, distinct (host, path), that a rule fits.

    The longest rule (host and path together) wins; of those as long, the one with the longer host.
    Rules are broadcast after a count; more than most_broadcast are shuffled, copied SALTS times, against
    expressions dealt to the copies, so that an expression shared by very many targets is no hot key.
    """
    rules = rule_table(rules)
    depth, n = Depth.of(rules), rules.count()
    short = F.left("digest", F.lit(prefix_digits))
    table = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"), _digest(F.col("host"), F.col("path")).alias("rule_digest"))
    table = table.withColumn("short", F.left("rule_digest", F.lit(prefix_digits)))
    rows = targets.filter("host <> ''").withColumn("e", F.explode(expressions(F.col("host"), F.col("path"), depth)))
    rows = rows.select("host", "path", _digest(F.col("e.host"), F.col("e.path")).alias("digest")).withColumn("short", short)
    if n <= most_broadcast:
        met = rows.join(F.broadcast(table), "short")
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    fits = met.filter("digest = rule_digest")
    order = F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("length"), F.char_length("rule_host").alias("host_length"))
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order)
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.*")


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url", prefix_digits: int = PREFIX_DIGITS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all that end in a dot and its host, if the path begins
    with the rule's. rule is null, and the verdict `default`, where none fits, as for a null url or one
    without `://` (host and path are empty then). Null and repeated page_ids are pages like any other;
    other columns are ignored; no pages give no rows; no rules leave the default. Very long URLs are
    judged whole: expressions go as deep as rules do.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = best_rules(rows.select("host", "path").distinct(), rules, prefix_digits, most_broadcast)
    return rows.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op11_url_filters(spark, sf_dir: str) -> DataFrame:
    """All pages under RULES; allow where none fits."""
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS r(host, path, verdict)")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def oracle() -> str:
    """Each rule tested against each page, longest first."""
    fits = "(p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)"
    return f"""
WITH r(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (SELECT row_number() OVER () AS i, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT i, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict FROM p JOIN r ON {fits} GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (i)
"""
