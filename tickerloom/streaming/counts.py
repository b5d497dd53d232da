"""Day x label counts of labelled news as its files arrive, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tickerloom import schemas
from tickerloom.functions.values import lenient_timestamp
from tickerloom.sources import store

COUNTS = "symbol string, label string, n bigint, newest timestamp_ntz, day string"


def landed_labels(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Labelled news as it lands: symbol, ts, label, url. Rows without a readable date are left out."""
    rows = (
        spark.readStream.schema(schemas.LABELLED_NEWS).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(folder)
    )
    ts = lenient_timestamp(F.col("date")).cast("timestamp")
    return rows.select(F.col("ticker").alias("symbol"), ts.alias("ts"), F.col("sentiment").alias("label"), "url").where("ts IS NOT NULL")


def daily_counts(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Streaming counts per symbol, calendar day and label of each article once.

    An article is a symbol, time and url; a file that lands again counts nothing
    twice. Rows up to ``late`` behind the newest time still count; state older
    than that is let go, and later rows are dropped.
    """
    once = rows.withWatermark("ts", late).dropDuplicates(["symbol", "ts", "url"])
    return once.groupBy(F.window("ts", "1 day").alias("_day"), "symbol", "label").agg(
        F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("newest")
    ).select("symbol", "label", "n", "newest", F.to_date("_day.start").cast("string").alias("day"))


def count_landed(
    spark: SparkSession, folder: str, target: str, checkpoint: str, late: str = "7 days", files_per_batch: int = 1000
) -> StreamingQuery:
    """Start counting all files not yet taken into the table at ``target``; the query ends after them.

    Each batch's changed counts replace the old ones under their symbol, day and
    label, and only their days' folders are written; a batch that runs twice
    leaves the same table. Stop the query to change ``late``.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.replace(batch, target, ["day"], ["symbol", "label", "day"])

    counts = daily_counts(landed_labels(spark, folder, files_per_batch), late)
    return (
        counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    """The table with the columns of ``news.daily_counts``."""
    return store.read(spark, target, T.StructType.fromDDL(COUNTS)).select("symbol", F.col("day").cast("date").alias("day"), "label", "n", "newest")
