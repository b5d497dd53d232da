"""The tables behind the dashboard, for all symbols at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickerloom.constants import BODY_COLUMNS, DASHBOARD_LABELS, LABEL_DISPLAY
from tickerloom.functions import replies as rp, text as tx, values as v
from tickerloom.operators import fundamentals as fd, labels as lb, news as nw
from tickerloom.operators.replies import with_sections, unnest

# fixed values: grade names as shown, and the fields they are read from
GRADE_FIELDS = {
    "Strong Buy": "strongBuy", "Buy": "buy", "Hold": "hold", "Sell": "sell", "Strong Sell": "strongSell",
}


def verdicts(analyses: DataFrame) -> DataFrame:
    judgment = F.col("investment_judgment")
    return analyses.select(
        "symbol", rp.verdict(judgment).alias("verdict"), rp.has_verdict(judgment).alias("has_verdict")
    )


def section_cards(analyses: DataFrame) -> DataFrame:
    """One row per section that has text: heading, tone, body as HTML."""
    found = with_sections(analyses.select("symbol", "investment_judgment"), "investment_judgment")
    return unnest(found, ["symbol"], F.col("found"), "section").where(F.col("body") != "").select(
        "symbol", "section", rp.card_tone(F.col("section")).alias("tone"), tx.markdown_to_html(F.col("body")).alias("html")
    )


def grade_bars(fundamentals: DataFrame) -> DataFrame:
    """Five grades with their share, for symbols that have a consensus."""
    first = fd.first_record(fundamentals, "analyst", "grades_consensus")
    tally = fundamentals.where(first.isNotNull()).select(
        "symbol", *[F.coalesce(first[field], F.lit(0)).alias(name) for name, field in GRADE_FIELDS.items()]
    )
    return fd.grade_shares(tally, "symbol", list(GRADE_FIELDS))


def grade_change_rows(fundamentals: DataFrame) -> DataFrame:
    """Latest grade changes with display names, in the provider's order."""
    changes = F.posexplode(fd.records(fundamentals, "analyst", "stock_grades")).alias("place", "change")
    flat = fundamentals.select(F.col("symbol").alias("_symbol"), changes).select("_symbol", "place", "change.*")
    shown = fd.grade_changes(flat, keep=["_symbol", "place"])
    return shown.withColumnRenamed("_symbol", "symbol")


def label_cards(labelled: DataFrame) -> DataFrame:
    shares = lb.label_shares(nw.daily_counts(labelled), DASHBOARD_LABELS, digits=0)
    return shares.withColumn("shown", v.display(F.col("label"), LABEL_DISPLAY))


def daily_trend(labelled: DataFrame) -> DataFrame:
    return lb.day_pivot(nw.daily_counts(labelled), DASHBOARD_LABELS)


def news_feed(labelled: DataFrame, chosen: Sequence[str] = tuple(LABEL_DISPLAY), newest_first: bool = True) -> DataFrame:
    """Cards of the chosen labels in date order: label, time, title, body."""
    by_date = F.col("date").desc() if newest_first else F.col("date").asc()
    titles = [F.col(c) for c in ("title_ko", "title") if c in labelled.columns]
    bodies = [F.col(c) for c in BODY_COLUMNS if c in labelled.columns]
    body = v.first_nonblank(bodies) if bodies else F.lit(None).cast("string")
    return nw.with_labels(labelled, "sentiment", list(chosen)).orderBy("symbol", by_date, "url").select(
        "symbol",
        v.display(F.col("sentiment"), LABEL_DISPLAY).alias("label"),
        v.dotted_text(F.col("date")).alias("shown_date"),
        tx.escape_html(v.first_filled(titles, "제목 없음")).alias("title"),
        tx.markdown_to_html(body).alias("body"),
        "url",
    )
