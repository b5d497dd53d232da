"""Cleaning, prompts and markup of article text as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from tickerloom.constants import (
    BLOCKED_KEYWORDS, BOILERPLATE_PATTERNS, JUNK_TITLES,
    MIN_PARAGRAPH_CHARS, NOISE_KEYWORDS,
)
from tickerloom.functions.values import SPACE, strip


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Case-insensitive test for any keyword; null text gives null.

    The text is lower-cased once, as the only item of an array, and not once
    per keyword.
    """
    if not keywords:
        return F.when(text.isNotNull(), F.lit(False))
    return F.exists(
        F.array(F.lower(text)),
        lambda t: reduce(or_, [F.contains(t, F.lit(word.lower())) for word in keywords]),
    )


def has_noise(content: Column, keywords: Sequence[str] = NOISE_KEYWORDS) -> Column:
    """Row filter form: missing content does not count as noise."""
    return F.coalesce(contains_any(content, keywords), F.lit(False))


def is_noise(content: Column, keywords: Sequence[str] = NOISE_KEYWORDS) -> Column:
    """Predicate form: missing content is noise."""
    return F.coalesce(contains_any(content, keywords), F.lit(True))


def is_blocked(content: Column, keywords: Sequence[str] = BLOCKED_KEYWORDS) -> Column:
    """The body is a bot-protection page. A flag, not a row filter."""
    return F.coalesce(contains_any(content, keywords), F.lit(False))


def is_junk_title(title: Column) -> Column:
    return strip(F.coalesce(title, F.lit(""))).isin(*JUNK_TITLES)


# Runs of blanks other than one plain space, which is already what it becomes.
# The look-ahead passes over printable ASCII without testing the class.
BLANK_RUN = rf"(?U)(?! (?!{SPACE}))(?=[^!-~]){SPACE}+"
WIDE_BLANK_RUN = rf"(?U)(?=[^!-~]){SPACE}{{3,}}"


def collapse_spaces(text: Column) -> Column:
    """Every run of blanks becomes one space; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " "))


def literal_head(pattern: str) -> str:
    """The fixed text every match of ``pattern`` begins with, lower-cased."""
    plain = re.match(r"(?:[^\\.^$*+?{}\[\]|()]|\\[^A-Za-z0-9])*", pattern).group()
    if "|" in pattern:
        return ""
    if pattern[len(plain):len(plain) + 1] in ("*", "?", "{"):
        plain = plain[:-1]
    return re.sub(r"\\(.)", r"\1", plain).lower()


def strip_boilerplate(text: Column, patterns: Sequence[str] = BOILERPLATE_PATTERNS) -> Column:
    """Drop site boilerplate. The patterns run in order over the whole text,
    and an open ``.*`` takes everything up to its end.

    Texts that hold no pattern's fixed beginning skip the regular
    expressions; no pattern could change them.
    """
    whole = F.coalesce(text, F.lit(""))
    cleaned = whole
    for pattern in patterns:
        cleaned = F.regexp_replace(cleaned, "(?isu)" + pattern.replace(r"\d", r"\p{Nd}"), "")
    heads = [literal_head(p) for p in patterns]
    if patterns and all(heads):
        # letters that match s, i or k without regard to case, yet lower-case to something else
        odd = ["\u017f", "\u0131", "i\u0307"]
        cleaned = F.when(contains_any(whole, [*heads, *odd]), cleaned).otherwise(whole)
    return strip(F.regexp_replace(cleaned, WIDE_BLANK_RUN, "\n\n"))


def article_head(cleaned: Column, chars: int | None = None) -> Column:
    """The part of a cleaned article the article prompt carries: the whole, or its first ``chars`` characters."""
    return cleaned if chars is None else F.substring(cleaned, 1, chars)


def title_of(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def classifier_input(
    title: Column, content: Column, title_only: Column, chars: int | None = None,
    title_prefix: str = "제목: ", body_prefix: str = "\n\n본문:\n",
) -> Column:
    """Prompt text of the label model: the title alone when ``title_only``,
    otherwise the title and the body, or its first ``chars`` characters."""
    head = F.concat(F.lit(title_prefix), title)
    body = content if chars is None else F.substring(content, 1, chars)
    return F.when(title_only, head).otherwise(F.concat(head, F.lit(body_prefix), body))


def escape_html(text: Column) -> Column:
    # fixed values: the five escapes, & first
    for plain, escaped in [
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ]:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


# fixed values: rewrites of model markdown, in the order they apply. (?d) keeps
# "\n" the only line end, as in the SQL twin's engine.
MARKDOWN_REWRITES = [
    (rf"(?Udm)^{SPACE}*-{{2,}}{SPACE}*$", ""),
    (rf"(?U)#{{1,6}}{SPACE}*", ""),
    (rf"(?Udm)^{SPACE}*\[.+?\]{SPACE}*$", ""),
    (r"(?d)\*\*\*(.+?)\*\*\*", "<strong><em>$1</em></strong>"),
    (r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (rf"(?Udm)^\*{{1,2}}{SPACE}+", "• "),
    (r"(?d)\*(.+?)\*", "<em>$1</em>"),
    (r"\n{3,}", "\n\n"),
]


def markdown_to_html(text: Column) -> Column:
    html = escape_html(text)
    for pattern, replacement in MARKDOWN_REWRITES:
        html = F.regexp_replace(html, pattern, replacement)
    return F.replace(html, F.lit("\n"), F.lit("<br>"))


# fixed values: named references found in article markup; & comes last
NAMED_REFERENCES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"), ("&euro;", "€"),
    ("&amp;", "&"),
]
# fixed values: elements whose start or end closes an open paragraph
CLOSES_PARAGRAPH = (
    "p|address|article|aside|blockquote|body|div|dl|fieldset|footer|form|h[1-6]|header|"
    "hr|html|li|main|nav|ol|pre|section|table|td|th|tr|ul"
)
NOT_SHOWN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
PARAGRAPH_START = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_REST = rf"(?is)</?(?:{CLOSES_PARAGRAPH})(?:[\s/][^>]*)?>.*\z"
ANY_TAG = r"<[^>]*>"


NUMBERED_REFERENCE = r"&#([xX]?)([0-9A-Fa-f]+);"


def _numbered_char(mark: Column, digits: Column) -> Column:
    code = F.when(mark == "", digits).otherwise(F.conv(digits, 16, 10)).try_cast("bigint")
    known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(known, char).otherwise(F.lit("\ufffd"))


def unescape_html(text: Column) -> Column:
    """Decode numbered references and the named ones listed above."""
    between = F.split(text, NUMBERED_REFERENCE)
    found = [F.regexp_extract_all(text, F.lit(NUMBERED_REFERENCE), F.lit(group)) for group in (1, 2)]
    chars = F.concat(F.zip_with(*found, _numbered_char), F.array(F.lit("")))
    numbered = F.array_join(F.zip_with(between, chars, lambda part, char: F.concat(part, char)), "")
    plain = F.when(F.contains(text, F.lit("&#")), numbered).otherwise(text)
    for reference, char in NAMED_REFERENCES:
        plain = F.replace(plain, F.lit(reference), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


def paragraphs(html: Column, min_chars: int = MIN_PARAGRAPH_CHARS) -> Column:
    """Array of the page's paragraph texts longer than ``min_chars``.

    Row-local: the page is cut at each ``<p>``, each piece ends where the
    browser would close the paragraph, and tags inside it are dropped.
    """
    pieces = F.split(F.regexp_replace(html, NOT_SHOWN, ""), PARAGRAPH_START)
    bodies = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda p: unescape_html(F.regexp_replace(F.regexp_replace(p, PARAGRAPH_REST, ""), ANY_TAG, "")),
    )
    return F.transform(F.filter(bodies, lambda t: F.length(t) > min_chars), strip)


def page_text(html: Column) -> Column:
    return F.array_join(paragraphs(html), " ")
