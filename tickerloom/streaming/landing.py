"""Clean each landed news file once, as files arrive.

The query's checkpoint remembers the files it has read, so a re-run only
takes new ones: the streaming form of skipping finished work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom import schemas
from tickerloom.constants import NOISE_KEYWORDS
from tickerloom.operators.news import drop_noise, valid_news
from tickerloom.sources.landing import FILE_STAMP


def landed_news(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    rows = (
        spark.readStream.schema(schemas.RAW_NEWS).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    return rows.select("*", F.regexp_extract("_metadata.file_path", FILE_STAMP, 1).alias("crawl_date"))


def clean_landed(
    spark: SparkSession, folder: str, target: str, checkpoint: str,
    noise: Sequence[str] = NOISE_KEYWORDS, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Start cleaning all files not yet taken; the query ends after them."""
    cleaned = drop_noise(valid_news(landed_news(spark, folder, files_per_batch)), noise)
    return (
        cleaned.writeStream.format("parquet").partitionBy("ticker", "crawl_date")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
