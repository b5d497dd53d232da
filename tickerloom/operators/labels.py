"""Label statistics over the day x label counts of each symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.constants import DASHBOARD_LABELS, LABELS
from tickerloom.functions.values import day_text, exact, exact_mean, rounded, share_percent


def label_counts(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("label").isNotNull()).groupBy("symbol", "label").agg(F.sum("n").alias("n"))


def _label_columns(labels: Sequence[str]) -> list[Column]:
    return [
        F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(f"_n{i}")
        for i, label in enumerate(labels)
    ]


def label_shares(counts: DataFrame, labels: Sequence[str] = LABELS, digits: int = 1) -> DataFrame:
    """Count and share of every label, also of those never seen.

    One pass of conditional sums per symbol, turned into one row per label;
    no label table is joined.
    """
    per_symbol = counts.groupBy("symbol").agg(F.sum("n").alias("total"), *_label_columns(labels))
    cells = F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(f"_n{i}").alias("n")) for i, label in enumerate(labels)
    ])
    long = per_symbol.select("symbol", "total", F.inline(cells))
    return long.select(
        "symbol", "label", "n", "total",
        rounded(share_percent(F.col("n"), F.col("total")), digits).alias("pct"),
    )


def day_pivot(counts: DataFrame, labels: Sequence[str] = DASHBOARD_LABELS) -> DataFrame:
    """One column per label; null where a label has no rows that day."""
    return counts.groupBy("symbol", "day").agg(
        *[F.sum(F.when(F.col("label") == label, F.col("n"))).alias(label) for label in labels]
    )


def count_pairs(n: Column, newest: Column, label: Column) -> Column:
    """Collected ``(label, n)`` of a group, largest first.

    Equal counts go by the label's newest article: in a list that runs from
    new to old, the label met first. Only ever used where a group holds one row per label. Rows without a
    label are left out here and not by a filter, which would be pushed to the
    scan and keep these groups from sharing a shuffle with the totals.
    """
    age = F.lit("1970-01-01").cast("timestamp_ntz") - newest
    pair = F.when(label.isNotNull(), F.struct((-n).alias("minus"), age.alias("age"), label.alias("label")))
    pairs = F.array_sort(F.collect_list(pair))
    return F.transform(pairs, lambda p: F.struct(p["label"].alias("label"), (-p["minus"]).alias("n")))


def label_map(counts: DataFrame) -> DataFrame:
    """Per symbol a ``label -> count`` map, largest first."""
    per_label = counts.groupBy("symbol", "label").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
    return per_label.groupBy("symbol").agg(
        F.map_from_entries(count_pairs(F.col("n"), F.col("newest"), F.col("label"))).alias("sentiment_summary")
    )


def day_label_map(counts: DataFrame) -> DataFrame:
    """Per symbol a ``day -> (label -> count)`` map, days ascending."""
    per_day = counts.groupBy("symbol", "day").agg(
        count_pairs(F.col("n"), F.col("newest"), F.col("label")).alias("pairs")
    )
    # maps do not sort, so the pairs become maps only after the days are in order
    days = F.array_sort(F.collect_list(F.struct(day_text(F.col("day")).alias("day"), "pairs")))
    return per_day.groupBy("symbol").agg(
        F.map_from_entries(
            F.transform(days, lambda d: F.struct(d["day"], F.map_from_entries(d["pairs"])))
        ).alias("sentiment_by_date")
    )


def news_period(counts: DataFrame) -> DataFrame:
    """Row count, first and last day and the period text per symbol."""
    day = lambda name: day_text(F.col(name))
    return counts.groupBy("symbol").agg(
        F.sum("n").alias("news_count"),
        F.min("day").alias("_first"),
        F.max("day").alias("_last"),
    ).select(
        "symbol", "news_count",
        day("_first").alias("first_day"),
        day("_last").alias("last_day"),
        F.concat_ws(" ~ ", day("_first"), day("_last")).alias("news_period"),
    )


def mean_score(rows: DataFrame, symbol: str, score: str, digits: int = 3) -> DataFrame:
    """Number and mean of the finite scores; others are left out of both."""
    return rows.groupBy(F.col(symbol).alias("symbol")).agg(
        F.count(exact(F.col(score))).alias("n"), rounded(exact_mean(F.col(score)), digits).alias("mean_score")
    )
