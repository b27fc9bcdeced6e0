"""Ordered rules with evidence. Rules are data: lists of patterns compiled into one expression each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.functions.text import bind, strip_html, visible

HALF, FULL, UNKNOWN = "half", "full", "unknown"
GOVERNOR, PRESIDENT = "governor", "president"

# Phrases, each list from the most specific to the most general.
NEGATED_HALF = (
    r"\bno\s+(?:current|active|standing)?\s*half[-\s]?(?:staff|mast)\b",
    r"\bno\s+(?:current|active)\s+(?:flag\s+)?orders?\b",
    r"\bnot\s+(?:currently\s+)?(?:at|flying\s+at)\s+half[-\s]?(?:staff|mast)\b",
    r"\bhalf[-\s]?(?:staff|mast)\s+order\s+has\s+(?:expired|ended|concluded)\b",
    r"\bno\s+flags?\s+(?:are\s+)?(?:currently\s+)?lowered\b",
)
HALF_SIGNALS = (
    r"\bat\s+half[-\s]?(?:staff|mast)\b",
    r"\bto\s+half[-\s]?(?:staff|mast)\b",
    r"\bhalf[-\s]?(?:staff|mast)\b",
    r"\bflags?\s+(?:are|is|will\s+be|shall\s+be)\s+lowered\b",
    r"\blower(?:ed|ing)?\s+the\s+flags?\b",
    r"\blower(?:s|ed|ing)?\s+(?:the\s+)?flags?\b",
    r"\bflags?\s+lowered\b",
)
FULL_SIGNALS = (
    r"\bat\s+full[-\s]?staff\b",
    r"\bfull[-\s]?staff\b",
    r"\breturn(?:ed)?\s+to\s+(?:full|the\s+top)\b",
    r"\braised?\s+to\s+(?:full|the\s+top|the\s+peak)\b",
    r"\bno\s+(?:current|active)\s+(?:half[-\s]?staff\s+)?order",
    r"\bflags?\s+(?:are|is)\s+(?:currently\s+)?(?:flying\s+)?full\b",
)
PRESIDENT_SIGNALS = (
    r"\bthe\s+president\s+of\s+the\s+united\s+states\b",
    r"\bpresidential\s+proclamation\b",
    r"\bby\s+order\s+of\s+the\s+president\b",
    r"\bpresident\s+(?:has\s+)?(?:ordered|issued|proclaimed|directed)\b",
    r"\bwhite\s+house\b",
    r"\ball\s+federal\s+(?:buildings|installations)\b",
    r"\bauthority\s+vested\s+in\s+me\s+by\s+the\s+constitution\s+and\s+the\s+laws\s+of\s+the\s+united\s+states\b",
    r"\bat\s+the\s+white\s+house\s+and\s+upon\s+all\s+public\s+buildings\b",
    r"\bunited\s+states\s+embassies,?\s+legations\b",
)
GOVERNOR_SIGNALS = (
    r"\bgov(?:ernor)?\.?\s+(?:\w+[.'-]?\s+){1,3}(?:has\s+|is\s+)?(?:orders?|ordered|directs?|directed|announces?|announced|signs?|signed|lowers?|lowered|issues?|issued|proclaims?|proclaimed)\b",
    r"\bgovernor'?s?\s+flag\s+order\b",
    r"\bby\s+order\s+of\s+(?:the\s+)?governor\b",
    r"\bgovernor'?s?\s+(?:proclamation|order|executive\s+order)\b",
    r"\bexecutive\s+order\s+(?:no\.?\s*)?[\d-]+\b",
    r"\bthe\s+mayor\s+(?:has\s+)?(?:ordered|directed|issued)\b",
)
# Declarations of today's status, in order; those from GUARDED_FROM on count only outside prose.
DECLARATIONS = (
    r"flags?\s*status\s*[:\-–]\s*(half|full)[-\s]?(?:staff|mast)",
    r"flags?\s*status\s+(half|full)[-\s]?(?:staff|mast)\b",
    r"\bstatus\s*[:\-–]\s*(half|full)[-\s]?(?:staff|mast)\b",
    r"current(?:ly)?\s+(?:flag\s+)?status\s*[:\-–]\s*(half|full)",
    r"national\s+flag\s*[:\-–]\s*(half|full)\s*staff",
    r"united\s+states\s+flags?\s*:\s*(half|full)[-\s]?staff",
    r"status\s+notification[^.]{0,40}?,\s*(half|full)[-\s]?staff",
    r"\b(?:is|are)\s+currently\s+(?:being\s+flown\s+)?(?:at\s+)?(half|full)[-\s]?(?:staff|mast)\b",
    r"\bflags?\s+(?:is|are)\s+(?:currently\s+)?(?:flying\s+|being\s+flown\s+)?(?:at\s+)?(half|full)[-\s]?(?:staff|mast)\b",
    r"\bflags?\s+(?:will\s+be\s+|are\s+being\s+)?(?:flown|displayed)\s+at\s+(half|full)[-\s]?(?:staff|mast)\s+(?:today|now|until)",
    r"\bhas\s+ordered\s+that\b[^.]{0,200}?\bbe\s+(?:lowered|flown|raised|displayed)\s+(?:to|at)\s+(half|full)[-\s]?(?:staff|mast)",
    r"\bflags?\s+(?:is\s+|are\s+)?to\s+be\s+flown\s+at\s+(half|full)[-\s]?(?:staff|mast)",
    r"\bflags?\s+at\s+(half|full)[-\s]?(?:staff|mast)\b",
)
GUARDED_FROM = 11
PROSE_BEFORE = (
    r"\b(?:may|should|shall|when|whenever|if|authorized|proclaim|code|event|death|order(?:s|ed)?\s+that|policy|protocol|means|lower(?:ed|ing)?|"
    r"raise[sd]?|display(?:ed|s)?|fly|flown|flying|honou?r|memory|respect|newsroom|archive|notices?|history|past|previous)\b"
)
PROSE_CHARS = 70
# Patterns of county lines, of badges and of their votes.
COUNTY_LINE = r"(?iU)(?<![-\w])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+count(?:y|ies)\s+only[^:]{0,60}:\s*(?:half|full)[-\s]?staff"
COUNTY_SCOPED = r"(?iU)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+count(?:y|ies)\s+only[^:]{0,60}:\s*(half|full)[-\s]?staff"
WIDGET = r"""(?isU)<([a-z]+)[^>]*class=["'][^"']*flag[-_]status[^"']*["'][^>]*>(.{0,3000}?)</\1>"""
VOTE_HREF = r"""(?i)href=["'][^"']*flag[-_]?status[-_](half|full)"""
VOTE_TEXT = r"(?iU)flags?\s*status\s*[:\-–]?\s*(half|full)[-\s]?staff"
VOTE_IMAGE = r"""(?i)(half|full)[-_]staff[^"']*\.(?:png|jpg|svg|gif)"""
STATUS_HREF = r"""(?i)href=["']([^"']*flag[-_]?status[^"']*)"""


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """What the first pattern of the list that matches at all matches first; null if none does. None of them may match nothing at all.

    Most texts match none, which one search for all of them tells; else each pattern runs once.
    """
    found = F.array(*[F.regexp_extract(text, "(?iU)" + p, 0) for p in patterns])
    return F.when(text.rlike("(?iU)" + "|".join(patterns)), F.get(F.filter(found, lambda x: x != ""), 0))


def quoted(text: Column) -> Column:
    """In single quotes, or in double ones where only single ones occur."""

    def of(t: Column) -> Column:
        mark = F.when(F.contains(t, F.lit("'")) & ~F.contains(t, F.lit('"')), '"').otherwise("'")
        return F.concat(mark, t, mark)

    return bind(text, of)


def _verdict(value: Column, evidence: Column) -> Column:
    return F.struct(value.alias("value"), evidence.alias("evidence"))


def classify_status(text: Column) -> Column:
    """struct(value, evidence): a negated half is full; half beside full is unknown."""

    def of(v: Column) -> Column:
        neg, half, full = v["neg"], v["half"], v["full"]
        both = half.isNotNull() & full.isNotNull()
        value = F.when(neg.isNotNull(), FULL).when(both, UNKNOWN).when(half.isNotNull(), HALF).when(full.isNotNull(), FULL).otherwise(UNKNOWN)
        told = F.concat(F.lit("ambiguous: "), quoted(half), F.lit(" and "), quoted(full), F.lit(" both present"))
        return _verdict(value, F.when(neg.isNotNull(), F.concat(F.lit("negation: "), quoted(neg))).when(both, told).otherwise(F.coalesce(half, full)))

    signals = (("neg", NEGATED_HALF), ("half", HALF_SIGNALS), ("full", FULL_SIGNALS))
    return bind(bind(visible(text), lambda t: F.struct(*[first_match(t, p).alias(n) for n, p in signals])), of)


def classify_authority(text: Column) -> Column:
    """struct(value, evidence): a governor who acts on a president's word is still the governor."""

    def of(v: Column) -> Column:
        pres, gov = v["pres"], v["gov"]
        value = F.when(gov.isNotNull(), GOVERNOR).when(pres.isNotNull(), PRESIDENT).otherwise(UNKNOWN)
        both = F.concat(F.lit("governor acted, referencing federal: "), quoted(gov))
        return _verdict(value, F.when(pres.isNotNull() & gov.isNotNull(), both).otherwise(F.coalesce(gov, pres)))

    signals = (("pres", PRESIDENT_SIGNALS), ("gov", GOVERNOR_SIGNALS))
    return bind(bind(visible(text), lambda t: F.struct(*[first_match(t, p).alias(n) for n, p in signals])), of)


def outside(text: Column, pattern: str, context: str, chars: int) -> Column:
    """The first match of a pattern before which, within so many characters, the context does not match; null without one.

    The text is cut at its matches; what stands before each is carried along, no longer than needed.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    pairs = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))), lambda x: x["match"].isNotNull())
    last = lambda t: F.right(t, F.lit(chars))

    def step(state: Column, x: Column) -> Column:
        def of(before: Column) -> Column:
            found = F.coalesce(state["found"], F.when(~before.rlike(context), x["match"]))
            return F.struct(last(F.concat(before, x["match"])).alias("before"), found.alias("found"))

        return bind(last(F.concat(state["before"], x["gap"])), of)

    return F.aggregate(pairs, F.struct(F.lit("").alias("before"), F.lit(None).cast("string").alias("found")), step, lambda s: s["found"])


def current_status(html: Column) -> Column:
    """struct(value, evidence) of a current-status page: only an explicit declaration counts, county lines do not."""
    t = F.regexp_replace(visible(html), COUNTY_LINE, " ")
    may_be = "(?iU)" + "|".join(DECLARATIONS[GUARDED_FROM:])
    seen = bind(t, lambda x: F.struct(x.alias("text"), first_match(x, DECLARATIONS[:GUARDED_FROM]).alias("plain")))
    guarded = lambda t: F.coalesce(*[outside(t, "(?iU)" + p, "(?iU)" + PROSE_BEFORE, PROSE_CHARS) for p in DECLARATIONS[GUARDED_FROM:]])
    phrase = bind(seen, lambda v: F.coalesce(v["plain"], F.when(v["text"].rlike(may_be), guarded(v["text"]))))

    def of(v: Column) -> Column:
        phrase = v["phrase"]
        word = F.lower(F.regexp_extract(phrase, "(?is).*(half|full)", 1))
        missing = F.when(v["any"], "no explicit status declaration in page text")
        return _verdict(F.when(phrase.isNotNull(), word).otherwise(UNKNOWN), F.when(phrase.isNotNull(), F.concat(F.lit("declaration: "), quoted(phrase))).otherwise(missing))

    return bind(F.struct(F.trim(phrase).alias("phrase"), (t != "").alias("any")), of)


def county_exceptions(html: Column) -> Column:
    """array of struct(county, status), distinct, in order of appearance."""

    def one(m: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(m, COUNTY_SCOPED, 1), r"(?iU)^(?:Staff|Flag|Flags|Only)\s+", "")
        return F.struct(name.alias("county"), F.lower(F.regexp_extract(m, COUNTY_SCOPED, 2)).alias("status"))

    return F.array_distinct(F.transform(F.regexp_extract_all(visible(html), F.lit(COUNTY_SCOPED), 0), one))


def _votes(fragment: Column) -> Column:
    def say(kind: str, text: Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("value")))

    return F.concat(say("href", fragment, VOTE_HREF), say("text", strip_html(fragment), VOTE_TEXT), say("image", fragment, VOTE_IMAGE))


def toggle_status(html: Column) -> Column:
    """struct(value, evidence) of a page whose badge points at one of two static pages."""

    def facts(t: Column) -> Column:
        voting = F.filter(F.transform(F.regexp_extract_all(t, F.lit(WIDGET), 0), lambda w: _votes(w)), lambda v: F.size(v) > 0)
        links = F.regexp_extract_all(t, F.lit(STATUS_HREF), 1)
        both = t.rlike("(?i)flag[-_]?status[-_]half") & t.rlike("(?i)flag[-_]?status[-_]full")
        half, full = F.get(F.filter(links, lambda h: h.rlike("(?i)[-_]half")), 0), F.get(F.filter(links, lambda h: h.rlike("(?i)[-_]full")), 0)
        return F.struct(both.alias("both"), F.get(voting, 0).alias("votes"), half.alias("half"), full.alias("full"))

    def of(v: Column) -> Column:
        votes, half, full = v["votes"], v["half"], v["full"]
        values = F.array_distinct(F.transform(votes, lambda x: x["value"]))
        kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(votes, lambda x: x["kind"]))), "+")
        agree = F.size(values) == 1
        only_half, only_full = half.isNotNull() & full.isNull(), full.isNotNull() & half.isNull()
        value = F.when(v["both"], UNKNOWN).when(votes.isNotNull(), F.when(agree, F.get(values, 0)).otherwise(UNKNOWN)).when(only_half, HALF).when(only_full, FULL).otherwise(UNKNOWN)
        said = F.when(agree, F.concat(F.lit("flag-status widget ("), kinds, F.lit(" all say "), F.get(values, 0), F.lit(")"))).otherwise(
            F.concat(F.lit("flag-status widget disagrees with itself: "), F.array_join(F.transform(votes, lambda x: F.concat(x["kind"], F.lit("="), x["value"])), ", "))
        )
        evidence = (
            F.when(v["both"], "both half and full variants present in the source")
            .when(votes.isNotNull(), said)
            .when(only_half, F.concat(F.lit("only half page linked: "), half))
            .when(only_full, F.concat(F.lit("only full page linked: "), full))
            .when(half.isNotNull() & full.isNotNull(), "both half and full pages linked, and no flag-status widget")
            .otherwise("no flag-status link found on this page")
        )
        return _verdict(value, evidence)

    return bind(bind(F.coalesce(html, F.lit("")), facts), of)
