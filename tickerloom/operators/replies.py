"""Model replies as rows: analyses, translated items, sections.

Each step that costs a parse or a search is a column of its own, so the
expressions built on it read the result instead of repeating the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.constants import REPLY_CALL_FAILED, REPLY_PARSE_FAILED, SECTIONS
from tickerloom.functions import replies as rp
from tickerloom.functions.values import first_filled, strip


def with_analysis(df: DataFrame, reply: Column, error: Column | None = None) -> DataFrame:
    """Add the article analysis columns; an unreadable reply gives the fixed
    record, a missing field its default."""
    failed = F.lit(REPLY_PARSE_FAILED)
    if error is not None:
        failed = F.when(error.isNotNull(), F.lit(REPLY_CALL_FAILED)).otherwise(failed)
    parsed = F.col("_parsed")
    return (
        df.withColumn("_items", rp.strict_json(rp.drop_fences(reply), rp.ARTICLE_REPLY))
        .withColumn("_parsed", rp.only_item(F.col("_items")))
        .select(
            *df.columns,
            F.coalesce(parsed["summary_ko"], F.lit("")).alias("summary_ko"),
            F.when(parsed.isNull(), failed).otherwise(F.coalesce(parsed["sentiment"], F.lit(""))).alias("sentiment"),
            F.coalesce(parsed["score"], F.lit(0.0)).alias("score"),
            F.coalesce(F.array_join(parsed["keywords"], ", "), F.lit("")).alias("keywords"),
            F.coalesce(parsed["impact"], F.lit("")).alias("impact"),
        )
    )


def with_translations(df: DataFrame, reply: Column, name: str = "items") -> DataFrame:
    """Add the translated items as an array; an unreadable reply has none."""
    read = F.transform(
        rp.only_item(F.col("_lists")),
        lambda r: F.struct(
            r["id"].alias("id"),
            first_filled([r["title"], r["제목"]], "").alias("title"),
            first_filled([r["content"], r["내용"]], "").alias("content"),
        ),
    )
    none = F.array().cast("array<struct<id: bigint, title: string, content: string>>")
    return (
        df.withColumn("_lists", rp.strict_json(rp.inside_fence(reply), rp.TRANSLATION_REPLY))
        .withColumn(name, F.coalesce(read, none))
        .drop("_lists")
    )


def with_sections(df: DataFrame, text: str, name: str = "found", sections: Sequence[str] = SECTIONS) -> DataFrame:
    """Add an array of ``(section, body)`` for the headings that are present.

    A body runs to the first later heading of the list that occurs; if that
    one stands earlier in the text, the body is empty.
    """
    whole = F.col(text)
    places = range(len(sections))
    # one search for all headings; the first of each is found again by its text
    marks = F.when(F.contains(whole, F.lit("[")), F.regexp_extract_all(whole, F.lit(rp.heading_pattern(sections)), F.lit(0)))
    names = lambda section: lambda m: strip(F.substring(m, F.lit(2), F.length(m) - 2)) == section
    marked = df.withColumn("_marks", marks).select(
        *df.columns, *[F.get(F.filter("_marks", names(s)), F.lit(0)).alias(f"_mark{i}") for i, s in enumerate(sections)]
    )
    mark, at = ([F.col(f"_{name}{i}") for i in places] for name in ("mark", "at"))
    placed = marked.select("*", *[F.when(mark[i].isNotNull(), F.position(mark[i], whole)).alias(f"_at{i}") for i in places])

    def stars(around: Column, near: Column) -> Column:
        return F.when(around == "**", 2).when(near == "*", 1).otherwise(0)

    started = placed.select("*", *[
        c for i in places for c in (
            (at[i] - stars(F.substring(whole, at[i] - 2, F.when(at[i] > 2, 2).otherwise(0)), F.substring(whole, at[i] - 1, F.when(at[i] > 1, 1).otherwise(0)))).alias(f"_start{i}"),
            (at[i] + F.length(mark[i]) + stars(F.substring(whole, at[i] + F.length(mark[i]), F.lit(2)), F.substring(whole, at[i] + F.length(mark[i]), F.lit(1)))).alias(f"_begin{i}"),
        )
    ])
    start = [F.col(f"_start{i}") for i in places]
    cut = []
    for i, section in enumerate(sections):
        begin = F.col(f"_begin{i}")
        until = F.coalesce(*start[i + 1:], F.length(whole) + 1)
        body = strip(F.substring(whole, begin, F.greatest(until - begin, F.lit(0))))
        cut.append(F.when(start[i].isNotNull(), F.struct(F.lit(section).alias("section"), body.alias("body"))))
    return started.select(*df.columns, F.array_compact(F.array(*cut)).alias(name))


def unnest(df: DataFrame, keep: Sequence[str], structs: Column, marker: str) -> DataFrame:
    """One row per struct of an array that is costly to work out.

    The plain generator makes Spark infer a filter on the array's size and
    push it down, which works the array out twice. The outer one does not;
    rows of empty arrays are dropped here by ``marker``, a field that is
    never null.
    """
    return df.select(*keep, F.inline_outer(structs)).where(F.col(marker).isNotNull())


def section_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return unnest(with_sections(df, text), [key], F.col("found"), "section")


def with_section_map(df: DataFrame, text: str, name: str = "sections") -> DataFrame:
    return with_sections(df, text, "_found").withColumn(name, F.map_from_entries("_found")).drop("_found")
