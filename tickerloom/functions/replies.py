"""Reading model replies: labels, JSON, sections, verdict."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tickerloom.constants import (
    DEFAULT_LABEL, LABELS, VERDICT_NO_WORD, VERDICT_SECTION, VERDICT_YES_WORD,
)
from tickerloom.functions.values import SPACE, strip

ARTICLE_REPLY = (
    "struct<summary_ko: string, sentiment: string, score: double, keywords: array<string>, impact: string>"
)
TRANSLATION_REPLY = "array<struct<id: bigint, title: string, content: string, `제목`: string, `내용`: string>>"


def read_label(reply: Column, labels: Sequence[str] = LABELS, default: str = DEFAULT_LABEL) -> Column:
    """First word of the reply that is a label in any case, else ``default``. What is neither letter nor space is left out first."""
    words = [label for label in labels if label.isascii() and label.isalpha() and label == label.capitalize()]
    if not words:
        return F.when(reply.isNotNull() | reply.isNull(), F.lit(default))
    letters = F.regexp_replace(reply, rf"(?U)[^a-zA-Z{SPACE[1:-1]}]+", "")
    found = F.regexp_extract(letters, rf"(?i)(?<![a-z])(?:{'|'.join(words)})(?![a-z])", 0)
    return F.when(found != "", F.initcap(found)).otherwise(F.lit(default))


def drop_fences(reply: Column) -> Column:
    """Remove every code fence marker."""
    return strip(F.regexp_replace(reply, "```json|```", ""))


def inside_fence(reply: Column) -> Column:
    """Text between the first pair of fences; unfenced replies stay."""
    fence = F.lit("```")
    opened = F.substring(reply, F.locate("```", reply) + 3, F.length(reply))
    body = strip(F.regexp_replace(strip(F.substring_index(opened, "```", 1)), "^json", ""))
    return F.when(F.contains(reply, fence), body).otherwise(reply)


def strict_json(text: Column, item: str) -> Column:
    """``text`` read as the only item of a JSON array of ``item`` type.

    Plain parsing passes over text behind the value; inside an array the
    parser rejects it. Take the value where the array has exactly one item.
    """
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{item}>")


def only_item(items: Column) -> Column:
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def heading_pattern(names: Sequence[str]) -> str:
    """Any of the headings in its brackets."""
    return rf"(?U)\[{SPACE}*(?:{'|'.join(map(re.escape, names))}){SPACE}*\]"


def verdict_text(text: Column) -> Column:
    """What follows the verdict heading up to the next bracket."""
    return F.regexp_extract(text, rf"(?U)\[{SPACE}*{VERDICT_SECTION}{SPACE}*\]([^\[]*)", 1)


def has_verdict(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(rf"(?U)\[{SPACE}*{VERDICT_SECTION}{SPACE}*\]")), F.lit(False))


def verdict(text: Column) -> Column:
    """``no`` / ``yes`` / ``hold``; a missing heading counts as hold."""
    said = F.coalesce(verdict_text(text), F.lit(""))
    return (
        F.when(F.contains(said, F.lit(VERDICT_NO_WORD)), F.lit("no"))
        .when(F.contains(said, F.lit(VERDICT_YES_WORD)), F.lit("yes"))
        .otherwise(F.lit("hold"))
    )


def card_tone(title: Column) -> Column:
    return (
        F.when(F.contains(title, F.lit("긍정")), F.lit("positive"))
        .when(F.contains(title, F.lit("부정")), F.lit("negative"))
        .otherwise(F.lit("plain"))
    )
