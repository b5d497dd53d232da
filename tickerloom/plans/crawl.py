"""Feed items and landed pages to raw news."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tickerloom.constants import MIN_ARTICLE_CHARS
from tickerloom.functions.values import in_publish_window
from tickerloom.operators.news import keep_articles


def crawled_news(
    items: DataFrame, pages: DataFrame, as_of: datetime, min_chars: int = MIN_ARTICLE_CHARS,
) -> DataFrame:
    """Items of the publish window with the text of their page.

    ``items``: ticker, title, link, date. ``pages``: link, url, html, where
    ``url`` is the address the link led to. Only pages that a wanted item
    links to are parsed, each once however many items link to it.
    """
    wanted = items.where(in_publish_window(F.col("date"), as_of))
    linked = pages.join(wanted.select("link").distinct(), "link", "left_semi")
    parsed = keep_articles(linked, min_chars).select("link", "content", "url")
    return wanted.join(parsed, "link").select("ticker", "title", "date", "content", "url")
