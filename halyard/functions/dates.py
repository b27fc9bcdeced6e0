"""Dates in text. Only years 20xx count; what does not parse is null. `as_of` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.functions.text import bind, strip_html, visible

# Months, and the date patterns in their order of priority with the format of year, month and day.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = "|".join(MONTHS) + "|" + "|".join(m[:3] for m in MONTHS)
DATE_PATTERNS = (
    (r"(?U)\b(20[0-9][0-9])-([0-9]{1,2})-([0-9]{1,2})(?![0-9])", (1, 2, 3)),
    (rf"(?iU)\b({MONTH})\.?\s+([0-9]{{1,2}}),?\s+(20[0-9][0-9])\b", (3, 1, 2)),
    (rf"(?iU)\b([0-9]{{1,2}})\s+({MONTH})\.?\s+(20[0-9][0-9])\b", (3, 2, 1)),
    (r"(?U)\b([0-9]{1,2})/([0-9]{1,2})/(20[0-9][0-9])\b", (3, 1, 2)),
    (r"(?U)([0-9]{1,2})\s+([A-Za-z]{3})\s+(20[0-9][0-9])", (3, 2, 1)),  # as in RFC 822
)
# Patterns of ranges, of advertised windows and of modification dates. [0-9] stands for ASCII digits only,
# because U lets \\d match the digits of all scripts.
RANGE = r"(?iUd)(?:from|beginning|effective)\s+(.{0,60}?)\s+(?:through|until|to)\s+(.{0,60}?)(?:[.;]|$)"
UNTIL = r"(?iUd)(?:until|through)\s+(?:sunset\s+(?:on\s+)?)?(.{0,40})"
ADVERTISED_FROM = r"(?iU)\bfrom\s*:?\s*(?:sunrise|sunset|noon)?\s*(?:[A-Z][a-z]+day,?\s*)?([^\n]{0,34})"
ADVERTISED_UNTIL = r"(?iU)\b(?:until|through|thru)\s*:?\s*(?:sunset|sunrise|noon|[0-9]{1,2}:[0-9]{2}\s*[ap]\.?m\.?\s*on)?\s*(?:[A-Z][a-z]+day,?\s*)?([^\n]{0,34})"
LAST_MODIFIED = (
    r"""(?i)name=["']DCTERMS\.modified["'][^>]*content=["']([^"']+)""",
    r"""(?i)property=["']article:modified_time["'][^>]*content=["']([^"']+)""",
    r"""(?i)name=["']last-modified["'][^>]*content=["']([^"']+)""",
    r"(?iU)last\s+updated\s*:?\s*([A-Z][a-z]+\s+[0-9]{1,2},?\s+20[0-9][0-9])",
    r"(?iU)updated\s+on\s+([A-Z][a-z]+\s+[0-9]{1,2},?\s+20[0-9][0-9])",
)
YEARLESS = rf"(?iU)\b({MONTH})\.?\s+([0-9]{{1,2}})\b(?!\s*,?\s*20[0-9][0-9])"


def _date(year: Column, month: Column, day: Column, named: bool) -> Column:
    """named: the first three letters of month count, else it is a number."""
    if named:
        return F.try_to_date(F.concat_ws("-", year, F.initcap(F.left(month, F.lit(3))), day), "yyyy-MMM-d")
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def _first(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    named = MONTH in pattern or "A-Za-z" in pattern
    return F.when(text.rlike(pattern), _date(*[F.regexp_extract(text, pattern, g) for g in order], named))


def parse_any_date(text: Column) -> Column:
    """The date of the first pattern, by priority, whose first match is a real date."""
    return bind(text, lambda t: F.coalesce(*[_first(t, p, order) for p, order in DATE_PATTERNS]))


def date_range(text: Column) -> Column:
    """struct(start_date, end_date): a from-through phrase, an until phrase, or a single date."""

    def of(t: Column) -> Column:
        s, e = (parse_any_date(F.regexp_extract(t, RANGE, g)) for g in (1, 2))
        single = F.struct(parse_any_date(t).alias("start_date"), parse_any_date(F.regexp_extract(t, UNTIL, 1)).alias("end_date"))
        return bind(F.struct(s.alias("start_date"), e.alias("end_date")), lambda r: F.when(r["start_date"].isNotNull() | r["end_date"].isNotNull(), r).otherwise(single))

    return bind(visible(text), of)


def advertised_window(html: Column) -> Column:
    """struct(start_date, end_date) that a current-status page states as From and Until."""
    spans = (("start_date", ADVERTISED_FROM), ("end_date", ADVERTISED_UNTIL))
    return bind(visible(html), lambda t: F.struct(*[parse_any_date(F.regexp_extract(t, p, 1)).alias(n) for n, p in spans]))


def newest_date(text: Column) -> Column:
    """The latest date of all matches of all patterns."""
    return bind(text, lambda t: F.array_max(F.concat(*[F.transform(F.regexp_extract_all(t, F.lit(p), 0), parse_any_date) for p, _ in DATE_PATTERNS[:4]])))


def yearless_dates(text: Column) -> Column:
    """array of struct(month, day), as written, of all dates that lack a year."""
    return F.transform(F.regexp_extract_all(text, F.lit(YEARLESS), 0), lambda m: F.struct(F.regexp_extract(m, YEARLESS, 1).alias("month"), F.regexp_extract(m, YEARLESS, 2).alias("day")))


def newest_yearless_date(dates: Column, as_of: Column) -> Column:
    """The latest of dates without a year: of this year, or of the last one if that is over a month ahead."""

    def of_year(x: Column, year: Column) -> Column:
        return bind(_date(year.cast("string"), x["month"], x["day"], True), lambda d: F.when(F.datediff(d, as_of) <= 31, d))

    year = F.year(as_of)
    return F.array_max(F.transform(dates, lambda x: F.coalesce(of_year(x, year), of_year(x, year - 1))))


def signs_of_freshness(html: Column, header: Column | None = None) -> Column:
    """struct(modified, yearless), whatever the day: the date of header, metadata or text, and where there is none the dates without year."""
    signs = [parse_any_date(header)] if header is not None else []
    signs += [parse_any_date(F.regexp_extract(html, p, 1)) for p in LAST_MODIFIED]
    found = bind(strip_html(html), lambda t: bind(F.coalesce(*signs, newest_date(t)), lambda d: F.struct(d.alias("modified"), F.when(d.isNull(), yearless_dates(t)).alias("yearless"))))
    return found


def modified_on(signs: Column, as_of: Column) -> Column:
    """The date of last modification that these signs tell on a day."""
    return F.coalesce(signs["modified"], newest_yearless_date(signs["yearless"], as_of))


def page_last_modified(html: Column, as_of: Column, header: Column | None = None) -> Column:
    """The best sign of a page's freshness: header, metadata, newest date in its text, newest date without year."""
    return bind(signs_of_freshness(html, header), lambda s: modified_on(s, as_of))


def mail_date(value: Column) -> Column:
    """The calendar date of an RFC 822 date in the sender's own offset; null if it is none."""
    day = F.regexp_extract(value, r"([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\s+([0-9]{4})\s+[0-9]{1,2}:[0-9]{2}", 0)
    y, m, d = (F.regexp_extract(day, r"([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\s+([0-9]{4})", g) for g in (3, 2, 1))
    return F.when(day != "", _date(y, m, d, True))
