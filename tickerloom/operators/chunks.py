"""Fixed-size chunks of a ticker's articles and the replies to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.constants import CHUNK_ROWS
from tickerloom.functions.text import collapse_spaces
from tickerloom.operators.ordering import number_rows
from tickerloom.operators.replies import unnest, with_translations
from tickerloom.session import durable_table


def row_ids(news: DataFrame, ticker: str, order: Sequence[Column], total: str | None = None) -> DataFrame:
    """1-based row id per ticker, in order, over any number of tasks."""
    return number_rows(news, [ticker], order, "row_id", total)


def with_chunks(numbered: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    return numbered.withColumn("chunk", F.floor((F.col("row_id") - 1) / size))


def prompt_line(row_id: Column, date: Column, title: Column, content: Column) -> Column:
    # fixed values: the line format of a chunk prompt; its ids count from 0
    return F.concat(
        F.lit("[ID:"), (row_id - 1).cast("string"), F.lit("] 날짜: "), date,
        F.lit(" | 제목: "), title, F.lit(" | 본문: "), collapse_spaces(content),
    )


def chunk_prompts(
    news: DataFrame, size: int = CHUNK_ROWS, order: Sequence[Column] | None = None
) -> DataFrame:
    """One row per (ticker, chunk): the prompt lines and the rows behind them.

    Expects ``ticker, id, date, title, content, url``. ``id`` only orders the
    rows, so one story may stand under several tickers, and ids may repeat or be
    null; a missing title, date or body is empty in its line. ``order`` is of ids
    and dates, by default of ids.

    The news is written once with a number of its own; ids and dates alone are
    sorted, and the text is joined on that number, so a large ticker's text
    spreads over all tasks and what ``news`` filters on is read once.
    """
    written = durable_table(
        news.select("ticker", "id", "date", "title", "content", "url", F.monotonically_increasing_id().alias("_row"))
    )
    places = with_chunks(
        row_ids(written.select("ticker", "id", "date", "_row"), "ticker", [*(order or [F.col("id")]), F.col("_row")]), size
    )
    empty = F.lit("")
    row = F.struct(
        "row_id",
        prompt_line(
            F.col("row_id"), F.coalesce(F.col("date").cast("string"), empty), F.coalesce("title", empty), F.coalesce("content", empty)
        ).alias("line"),
        "date", "url",
    )
    # at most ``size`` rows meet in one group
    return (
        written.join(places.select("_row", "row_id", "chunk"), "_row")
        .groupBy("ticker", "chunk")
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
        .select(
            "ticker", "chunk",
            F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("prompt"),
            F.transform("rows", lambda r: F.struct(r["row_id"].alias("row_id"), r["date"].alias("date"), r["url"].alias("url"))).alias("rows"),
        )
    )


def zip_replies(replied: DataFrame) -> DataFrame:
    """n-th reply item with n-th row of the chunk, cut to the shorter side.

    A reply that leaves out an item shifts every later row; ``match_replies``
    does not.
    """
    pairs = F.slice(F.arrays_zip(F.col("rows"), F.col("items")), 1, F.least(F.size("rows"), F.size("items")))
    read = with_translations(replied, F.col("reply"))
    return _translated(unnest(read, ["ticker", "chunk"], pairs, "rows"))


def match_replies(replied: DataFrame) -> DataFrame:
    """Reply items put to the row whose id they carry; others are dropped."""
    read = with_translations(replied, F.col("reply"))
    pairs = F.transform("rows", lambda r: F.struct(
        r.alias("rows"),
        F.try_element_at(F.filter("items", lambda i: i["id"] == r["row_id"] - 1), F.lit(1)).alias("items"),
    ))
    return _translated(unnest(read, ["ticker", "chunk"], pairs, "items"))


def unanswered(replied: DataFrame) -> DataFrame:
    """Rows of a chunk that no reply item answers."""
    read = with_translations(replied, F.col("reply"))
    open_rows = F.filter("rows", lambda r: ~F.exists("items", lambda i: i["id"].eqNullSafe(r["row_id"] - 1)))
    return unnest(read, ["ticker", "chunk"], open_rows, "row_id").select("ticker", "chunk", "row_id")


def _translated(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("rows.row_id").alias("id"), "ticker", F.col("rows.date").alias("date"),
        F.col("items.title").alias("title"), F.col("items.content").alias("content"),
        F.col("rows.url").alias("url"),
    )
