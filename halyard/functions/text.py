"""Text functions: columns in, columns out. Null counts as empty unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Entities in the order in which they are decoded, so that `&amp;lt;` becomes `<`.
ENTITIES = (
    ("&amp;", "&"),
    ("&nbsp;", " "),
    ("&#39;", "'"),
    ("&quot;", '"'),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&rsquo;", "'"),
    ("&ldquo;", '"'),
    ("&rdquo;", '"'),
    ("&mdash;", "-"),
    ("&ndash;", "-"),
)

# Patterns. Flags: i ignores case, U makes classes Unicode, s lets the dot match line ends.
FLAG = r"(?iU)half[-\s]?(?:staff|mast)|flags?\s+(?:to|at|lowered|be\s+flown)|lower\s+the\s+flag|flag\s+(?:order|honors|status|notification)"
NOON = r"(?iU)until\s+noon|noon,?\s+then|half[-\s]?staff\s+until\s+12"
LIMITED_SCOPE = (
    r"(?iU)\bat\s+(?:the\s+)?state\s+capitol\b"
    r"|\bcapitol\s+(?:building\s+)?only\b"
    r"|\bat\s+the\s+capitol\s+complex\b"
    r"|\bonly\s+at\s+the\s+state\s+capitol\b"
    r"|\b(?:in|within)\s+[A-Z][a-z]+\s+County\s+only\b"
)
TRANSLATION = r"(?iU)^\s*(?:SPANISH|PORTUGUESE|SPANISH\s+TRANSLATION|TRADUCCI[OÓ]N)\s*[:\-]"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it; keeps plans small."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def strip_html(html: Column) -> Column:
    """Visible text: no scripts, styles or tags, CDATA unwrapped, entities decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?isU)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def visible(text: Column) -> Column:
    """strip_html where there is a `<`, else the text as it is."""
    return bind(text, lambda t: F.when(F.contains(t, F.lit("<")), strip_html(t)).otherwise(F.coalesce(t, F.lit(""))))


def content_hash(html: Column) -> Column:
    """16 hex digits that change with the visible text only."""
    return F.left(F.sha2(strip_html(html), 256), F.lit(16))


def order_hash(order: Column, kind: str) -> Column:
    """content_hash of an order, a struct of this type, as JSON with sorted keys: it changes with any field."""
    names = sorted(f.split(":")[0] for f in kind[kind.index("<") + 1 : -1].split(","))
    return content_hash(F.to_json(F.struct(*[order[n].alias(n) for n in names]), {"ignoreNullFields": "false"}))


def status_fingerprint(html: Column, hint: str | None = None) -> Column:
    """content_hash without clock times and long numbers, near the hint if the text has it."""
    text = strip_html(html)
    if hint:
        at = F.instr(F.lower(text), hint.lower())
        text = F.when(at > 0, F.substring(text, F.greatest(at - 200, F.lit(1)), F.least(at - 1, F.lit(200)) + 1200)).otherwise(text)
    text = F.regexp_replace(text, r"(?iU)\b\d{1,2}:\d{2}(:\d{2})?\s*(?:AM|PM)?\b", "")
    text = F.regexp_replace(text, r"(?U)\b\d{9,}\b", "")
    return F.left(F.sha2(text, 256), F.lit(16))


def is_relevant(text: Column, pattern: str = FLAG) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern)


def until_noon(text: Column) -> Column:
    return visible(text).rlike(NOON)


def order_scope(text: Column) -> Column:
    """struct(scope, evidence): limited with the phrase that limits it, else statewide."""
    phrase = F.regexp_substr(visible(text), F.lit(LIMITED_SCOPE))
    return bind(phrase, lambda p: F.struct(F.when(p.isNotNull(), "limited").otherwise("statewide").alias("scope"), F.trim(p).alias("evidence")))


def is_translation(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(TRANSLATION)


def first_sentences(text: Column, n: int = 3, chars: int = 700) -> Column:
    return F.substring(F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), 1, n), " "), 1, chars)


def or_else(*options: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def sender_domain(sender: Column) -> Column:
    """What follows the last @, without > and blanks, in lower case."""
    return F.lower(F.btrim(F.element_at(F.split(F.coalesce(sender, F.lit("")), "@"), -1), F.lit("> ")))


def site(url: Column) -> Column:
    """Scheme and host of a URL, null if it has none."""
    return F.concat_ws("://", F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST")))


@pandas_udf(StringType())
def _joined(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, h) if isinstance(h, str) and isinstance(b, str) else None for h, b in zip(href, base, strict=True)], dtype=object)


def absolute_url(href: Column, base: Column) -> Column:
    """href seen from base; base where href is missing."""
    plain = F.when(F.coalesce(href, F.lit("")) == "", base).when(href.startswith("http") | (F.coalesce(base, F.lit("")) == ""), href)
    return F.coalesce(plain, _joined(F.when(plain.isNull(), href), base))


@pandas_udf(ArrayType(StringType()))
def _all_joined(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([h if h is None or not isinstance(b, str) else [x and urljoin(b, x) for x in h] for h, b in zip(hrefs, base, strict=True)], dtype=object)


def absolute_urls(hrefs: Column, base: Column) -> Column:
    """absolute_url of each of an array's elements; only those that are relative go to Python."""
    has_base = F.coalesce(base, F.lit("")) != ""
    relative = lambda h: has_base & ~h.startswith("http") & (h != "")
    some = _all_joined(F.transform(hrefs, lambda h: F.when(relative(h), h)), base)
    return F.zip_with(hrefs, some, lambda h, joined: F.when(F.coalesce(h, F.lit("")) == "", base).otherwise(F.coalesce(joined, h)))


@pandas_udf(StringType())
def decode_header(value: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """RFC 2047 header text; null is empty, what cannot be decoded stays."""
    from email.header import decode_header as parts
    from email.header import make_header

    def one(v) -> str:
        try:
            return str(make_header(parts(v))) if v else ""
        except Exception:  # a broken header is shown as it is
            return str(v)

    for s in value:
        yield s.map(one)
