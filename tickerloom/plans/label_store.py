"""Label statistics kept as day x label partials: a new file changes its days only.

Partials add up, so every label statistic reads the store instead of the rows:
``daily`` has the columns of ``news.daily_counts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickerloom.functions.values import exact, rounded
from tickerloom.sources import store

PARTIALS = {
    "file": "string", "symbol": "string", "label": "string", "n": "bigint", "newest": "timestamp_ntz",
    "score_n": "bigint", "score_sum": "decimal(38,6)", "day": "string",
}

#: The day of rows without a date. They count in no daily statistic.
DATELESS = "none"


def partials(news: DataFrame, score: Column | None = None) -> DataFrame:
    """Per file, symbol, day and label what adds up. Expects ``file, symbol, date, sentiment``. Rows without a date are a day of their own."""
    value = exact(F.lit(None).cast("double") if score is None else score)
    date = F.col("date").cast("timestamp_ntz")
    return news.groupBy(
        F.col("file").cast("string").alias("file"), F.col("symbol").cast("string").alias("symbol"), F.col("sentiment").alias("label"),
        F.coalesce(F.to_date(date).cast("string"), F.lit(DATELESS)).alias("day"),
    ).agg(
        F.count("*").alias("n"), F.max(date).alias("newest"), F.count(value).alias("score_n"),
        F.sum(value).cast("decimal(38,6)").alias("score_sum"),
    ).select(*PARTIALS)


def land(news: DataFrame, path: str, score: Column | None = None, files: DataFrame | None = None) -> None:
    """Count ``news`` into the store at ``path``, in place of what its files had counted before.

    Only days that the files have, or had, are read and written. A file landed
    again counts as it is now; one that has no row any more is named in ``files``
    (column ``file``).
    """
    new = partials(news, score)
    landed = news.select(F.col("file").cast("string").alias("file")).distinct()
    store.replace(new, path, ["day"], ["file"], replaced=landed if files is None else landed.union(files.select("file")))


def read(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path, T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in PARTIALS.items())))


def daily(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, day, label, n, newest`` over all files, for every label statistic."""
    return read(spark, path).where(F.col("day") != DATELESS).groupBy("symbol", F.col("day").cast("date").alias("day"), "label").agg(
        F.sum("n").alias("n"), F.max("newest").alias("newest")
    )


def mean_scores(spark: SparkSession, path: str, digits: int = 3) -> DataFrame:
    """``labels.mean_score`` from the store."""
    total = F.sum("score_sum").cast("decimal(38,6)").cast("double")
    return read(spark, path).groupBy("symbol").agg(
        F.sum("score_n").alias("n"), rounded(F.try_divide(total, F.sum("score_n")), digits).alias("mean_score")
    )
