"""Text expressions that stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, spelt out so that every regex dialect reads it the same way.
WHITE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def or_empty(*values: Column) -> Column:
    """The first value that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))


def compact(value: Column) -> Column:
    """White space collapsed to single blanks, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), WHITE + "+", " "))


def excerpt(value: Column, most: int = 360) -> Column:
    """The compacted text, cut to `most` characters and marked with dots if longer."""
    text = compact(value)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("...")))


def content_hash(title: Column, content: Column) -> Column:
    """SHA-256 of the compacted, lower-cased title and content."""
    return F.sha2(F.lower(compact(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))))), 256)


def has_wide(term: str) -> bool:
    return any("一" <= c <= "鿿" for c in term)


def mentions(text: Column, lowered: Column, term: str) -> Column:
    """Whether a term occurs: terms with ideographs as written, others in lower case and not inside a longer word.

    The pattern is tried only on texts that hold the term at all, which a plain search tells far sooner.
    """
    if has_wide(term):
        return text.contains(term)
    return lowered.contains(term.lower()) & lowered.rlike(f"(?<![a-z0-9]){re.escape(term.lower())}(?![a-z0-9])")


def matched(text: Column, lowered: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur, in their given order; none in a null text."""
    return F.array_compact(F.array(*[F.when(mentions(text, lowered, t), F.lit(t)) for t in terms]))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any word occurs as written."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


#: A timestamp in ISO form, with or without an offset.
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"


def iso_seconds(value: Column) -> Column:
    """Whole seconds since 1970 UTC of an ISO timestamp, null for other forms and impossible dates; without an offset it is UTC."""
    day = F.datediff(F.substring(value, 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    part = lambda at: F.substring(value, at, 2).try_cast("long")
    offset = F.when(value.rlike(r"[+-]\d{2}:\d{2}$"), (F.substring(value, -5, 2).try_cast("long") * 3600 + F.substring(value, -2, 2).try_cast("long") * 60) * F.when(F.substring(value, -6, 1) == "-", -1).otherwise(1)).otherwise(0)
    return F.when(value.rlike(ISO), day * 86400 + part(12) * 3600 + part(15) * 60 + part(18) - offset)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def url_date(url: Column) -> Column:
    """The first valid 8-digit date of this century's form in a URL, not adjacent to digits, as a date."""
    runs = F.regexp_extract_all(url, F.lit(r"(?<!\d)(20\d{6})(?!\d)"), 1)
    valid = F.filter(F.transform(runs, lambda x: F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)).try_cast("date")), lambda x: x.isNotNull())
    return F.get(valid, F.lit(0))


_LABELLED = (
    r"(?:发布时间|发布日期|发稿时间|更新时间|日期|时间)\s*[:：]?\s*(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日",
    r"(?:发布时间|发布日期|发稿时间|更新时间|日期|时间)\s*[:：]?\s*(20\d{2})[-/](\d{1,2})[-/](\d{1,2})",
)


def text_date(text: Column) -> Column:
    """The date behind a label within the first 1200 characters, invalid ones passed over."""
    head = F.substring(text, 1, 1200)
    each = [F.concat_ws("-", F.regexp_extract(head, p, 1), F.lpad(F.regexp_extract(head, p, 2), 2, "0"), F.lpad(F.regexp_extract(head, p, 3), 2, "0")).try_cast("date") for p in _LABELLED]
    return F.coalesce(*each)
