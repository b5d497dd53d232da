"""Reading landed files: news CSV, fundamentals and analysis JSON, feeds."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickerloom import schemas
from tickerloom.functions.values import feed_timestamp
from tickerloom.session import durable_table
from tickerloom.sources import store
from tickerloom.sources.sinks import document_bucket

# ``{symbol}_{yymmdd}.csv`` and ``{symbol}_{yymmdd}_translated.csv``
FILE_SYMBOL = r"([^/]+?)_\d{6}(?:_translated)?\.csv$"
FILE_STAMP = r"_(\d{6})(?:_translated)?\.csv$"


def read_news(spark: SparkSession, path: str | Sequence[str], schema: str = schemas.RAW_NEWS) -> DataFrame:
    """All news files under ``path`` as one frame, with the file they are from.

    Quoted fields may hold line breaks, so a file is read by one task: land
    many files of ordinary size, not one large one.
    """
    rows = (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    file = F.col("_metadata.file_path")
    return rows.select(
        *rows.columns, file.alias("file"),
        F.regexp_extract(file, FILE_SYMBOL, 1).alias("file_symbol"),
        F.regexp_extract(file, FILE_STAMP, 1).alias("file_stamp"),
    )


#: Holds the text of a record that doesn't fit the schema.
BAD = "_bad"


def bad_lines(spark: SparkSession, path: str | Sequence[str], schema: str = schemas.RAW_NEWS) -> DataFrame:
    """Each CSV record with too few or too many fields: what ``read_news`` shows of it, its file and its ``text``.

    Written once: the files are not read again for every look at them.
    """
    return durable_table(_with_bad(spark, path, schema).where(F.col(BAD).isNotNull()).withColumnRenamed(BAD, "text"))


def file_report(spark: SparkSession, path: str | Sequence[str], schema: str = schemas.RAW_NEWS) -> DataFrame:
    """Per landed news file its records, how many don't fit the schema, and how many have no date. Written once, like ``bad_lines``."""
    return durable_table(_with_bad(spark, path, schema).groupBy("file").agg(
        F.count("*").alias("records"), F.count(BAD).alias("bad"), F.count_if(F.col("date").isNull()).alias("dateless")
    ))


def _with_bad(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    # without pruning every field is parsed, so that a record is judged whole
    rows = (
        spark.read.schema(f"{schema}, {BAD} string").option("columnNameOfCorruptRecord", BAD).option("columnPruning", False)
        .option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    )
    return rows.select(F.col("_metadata.file_path").alias("file"), *rows.columns)


def unreadable_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, symbol and text of each JSON document that can't be read as one of fundamentals; what came before the fault may be known."""
    schema = schemas.fundamentals_schema().add(BAD, "string")
    docs = spark.read.schema(schema).option("columnNameOfCorruptRecord", BAD).option("multiLine", True).json(path)
    broken = docs.where(F.col(BAD).isNotNull())
    return durable_table(broken.select(F.col("_metadata.file_path").alias("file"), F.col("meta.symbol").alias("symbol"), F.col(BAD).alias("text")))


def read_fundamentals(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    docs = spark.read.schema(schemas.fundamentals_schema()).option("multiLine", True).json(path)
    return docs.select(F.col("meta.symbol").alias("symbol"), *docs.columns, F.col("_metadata.file_size").alias("size_bytes"))


def read_analyses(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    schema = T.StructType.fromDDL(schemas.ANALYSIS)
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.col("meta.symbol").alias("symbol"), *schema.names, F.col("_metadata.file_path").alias("file"))


def read_documents(
    spark: SparkSession, path: str, symbol: str | None = None, model: str | None = None, run_date: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Documents written by ``sinks.write_documents``, every one of them; the filters prune folders."""
    schema = T.StructType.fromDDL("symbol string, " + schemas.ANALYSIS + ", model string, run_date string, bucket int")
    rows = store.read(spark, path, schema, fmt)
    if symbol is not None:
        rows = rows.where((F.col("symbol") == symbol) & (F.col("bucket") == document_bucket(F.lit(symbol))))
    if model is not None:
        rows = rows.where(F.col("model") == model)
    if run_date is not None:
        rows = rows.where(F.col("run_date") == run_date)
    return rows.select("symbol", "model", "run_date", *T.StructType.fromDDL(schemas.ANALYSIS).names)


def read_days(spark: SparkSession, path: str, stamp: str | None = None, days: DataFrame | None = None) -> DataFrame:
    """Rows written by ``sinks.write_days``: of one day, or of the days in the column ``crawl_date`` of ``days``.

    Either way only those days' folders are read: ``stamp`` prunes them when the
    query is planned, ``days`` when it runs.
    """
    stored = spark.read.parquet(path).schema
    typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "crawl_date" else f for f in stored])
    rows = spark.read.schema(typed).parquet(path)
    if stamp is not None:
        rows = rows.where(F.col("crawl_date") == stamp)
    if days is not None:
        rows = rows.join(days.select("crawl_date").distinct(), "crawl_date", "left_semi")
    return rows


def newest_files(rows: DataFrame, symbol: str = "file_symbol", stamp: str = "file_stamp") -> DataFrame:
    """The rows of ``read_news`` from each symbol's latest file.

    One small row per symbol and file goes into the aggregate and comes back by
    a join; paths are never collected.
    """
    files = rows.groupBy(symbol, "file").agg(F.max(stamp).alias("_stamp"))
    newest = files.groupBy(symbol).agg(F.max(F.struct("_stamp", "file")).alias("_newest")).select(
        F.col(symbol).alias("_symbol"), F.col("_newest.file").alias("_file")
    )
    return rows.join(newest, (F.col(symbol) == F.col("_symbol")) & (F.col("file") == F.col("_file")), "left_semi")


def read_feed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Feed items of landed XML files. ``unread_date`` marks items whose date can't be read."""
    items = spark.read.format("xml").option("rowTag", "item").schema(schemas.FEED_ITEM).load(path)
    date = feed_timestamp(F.col("pubDate"))
    return items.select("title", "link", date.alias("date"), (F.col("pubDate").isNotNull() & date.isNull()).alias("unread_date"))


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths under a folder. File contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        .select("path", F.col("length").alias("size_bytes"))
    )


def is_raw_file(path: Column) -> Column:
    return ~F.contains(path, F.lit("_translated"))


def is_dated_analysis(path: Column, model: str) -> Column:
    """``{symbol}_analysis_{model}_{anything}.json``; a name without the
    second underscore does not count."""
    return F.rlike(path, F.lit(rf"/[^/]+_analysis_{re.escape(model)}_[^/]*\.json$"))


def read_partitioned(spark: SparkSession, path: str, ticker: str | None = None, stamp: str | None = None) -> DataFrame:
    """News written by ``sinks.write_news``; the filters prune folders.

    Folder names are read as text: a ticker may be all digits, with zeros in front.
    """
    stored = spark.read.parquet(path).schema
    typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("ticker", "crawl_date") else f for f in stored])
    rows = spark.read.schema(typed).parquet(path)
    if ticker is not None:
        rows = rows.where(F.col("ticker") == ticker)
    if stamp is not None:
        rows = rows.where(F.col("crawl_date") == stamp)
    return rows
