"""Validation, noise and recency filters over news rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom.constants import MIN_ARTICLE_CHARS, NOISE_KEYWORDS, WINDOW_DAYS
from tickerloom.functions import text as tx
from tickerloom.functions.values import lenient_timestamp
from tickerloom.operators.lookups import attach


def valid_news(news: DataFrame) -> DataFrame:
    """Fill empty text, drop junk titles and rows without a readable date."""
    return (
        news.withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("content", F.coalesce("content", F.lit("")))
        .where(~tx.is_junk_title(F.col("title")))
        .withColumn("date", lenient_timestamp(F.col("date")))
        .where(F.col("date").isNotNull())
    )


def dropped_rows(news: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Per symbol the rows ``valid_news`` drops, by reason; a row with both counts as junk title."""
    junk = tx.is_junk_title(F.coalesce("title", F.lit("")))
    unread = lenient_timestamp(F.col("date")).isNull()
    return news.groupBy(F.col(symbol).alias("symbol")).agg(
        F.count("*").alias("rows"), F.count_if(junk).alias("junk_titles"), F.count_if(~junk & unread).alias("unread_dates")
    )


def drop_noise(news: DataFrame, keywords: Sequence[str] = NOISE_KEYWORDS) -> DataFrame:
    return news.where(~tx.has_noise(F.col("content"), keywords))


def keep_articles(pages: DataFrame, min_chars: int = MIN_ARTICLE_CHARS) -> DataFrame:
    """Pages whose paragraph text is long enough to be an article.

    The length test sits inside the generator: as a plain filter it would be
    pushed below the extraction and run it twice.
    """
    text = F.filter(F.array(tx.page_text(F.col("html"))), lambda t: F.length(t) > min_chars)
    return pages.select("*", F.explode_outer(text).alias("content")).where(F.col("content").isNotNull())


def recent_window(news: DataFrame, symbol: str = "symbol", ts: str = "date", days: int = WINDOW_DAYS) -> DataFrame:
    """Rows of the last ``days`` calendar days of each symbol.

    The last day per symbol is a plain maximum (combined before the
    shuffle), so no symbol's rows are sorted or gathered.
    """
    latest = news.groupBy(symbol).agg(F.to_date(F.max(ts)).alias("_latest"))
    return attach(news, latest, [symbol]).where(
        F.to_date(ts) >= F.date_sub("_latest", days - 1)
    ).drop("_latest")


def daily_counts(news: DataFrame, symbol: str = "symbol", ts: str = "date", label: str = "sentiment") -> DataFrame:
    """Rows per symbol, calendar day and label, and the time of the newest.

    At most days x labels rows per symbol whatever the news volume: the base
    of every label statistic.
    """
    return news.where(F.col(ts).isNotNull()).groupBy(
        F.col(symbol).alias("symbol"), F.to_date(ts).alias("day"), F.col(label).alias("label")
    ).agg(F.count("*").alias("n"), F.max(F.col(ts).cast("timestamp_ntz")).alias("newest"))


def recent_days(counts: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """``daily_counts`` cut to the last ``days`` days of each symbol."""
    latest = F.max("day").over(Window.partitionBy("symbol"))
    return counts.withColumn("_latest", latest).where(
        F.col("day") >= F.date_sub("_latest", days - 1)
    ).drop("_latest")


def window_retention(counts: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Rows per symbol before and after the recency window."""
    latest = F.max("day").over(Window.partitionBy("symbol"))
    kept = F.col("day") >= F.date_sub("_latest", days - 1)
    return counts.withColumn("_latest", latest).groupBy("symbol").agg(
        F.sum("n").alias("n_all"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_recent"),
    )


def select_present(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """The listed columns that exist, under their display names."""
    return df.select([F.col(c).alias(shown) for c, shown in renames.items() if c in df.columns])


def with_labels(news: DataFrame, label: str, chosen: Sequence[str]) -> DataFrame:
    """Rows whose label was chosen; choosing none keeps none."""
    return news.where(F.col(label).isin(*chosen) if chosen else F.lit(False))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Stack news frames of differing columns; absent ones become null."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked
