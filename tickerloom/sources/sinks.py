"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.sources import store

BOM = "\ufeff"


def write_news(news: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by ticker and crawl date. A symbol without rows writes no
    folder. Rebalancing gathers small tickers into few files and splits a
    large one over several tasks."""
    news.hint("rebalance", "ticker", "crawl_date").write.mode(mode).partitionBy("ticker", "crawl_date").parquet(path)


def write_csv(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """CSV with header; each file's first column name carries the byte-order
    mark that spreadsheet programs look for."""
    marked = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if by != df.columns[0] else df
    writer = marked.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"')
    if by:
        writer = writer.partitionBy(by)
    writer.csv(path)


#: Folders that the documents of one model and day are spread over, by symbol. Fixed once documents are written.
DOCUMENT_BUCKETS = 64


def document_bucket(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(DOCUMENT_BUCKETS)).cast("int")


def write_documents(docs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Nested documents by model, day of the run and a bucket of symbols; ``landing.read_documents`` reads them.

    ``fmt``: parquet, or json for one document a line; either way a file holds
    many. There is one document per symbol, model and day: a re-run replaces those
    it brings, and of several in ``docs`` the one analysed last stays. Other
    symbols, models and days stay as they are.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    keyed = docs.withColumns({
        "symbol": F.col("symbol").cast("string"), "model": F.when(named("meta.model") != "", F.col("meta.model")).otherwise("none"),
        "run_date": F.when(named("meta.analysis_date") != "", F.substring("meta.analysis_date", 1, 10)).otherwise("none"),
    }).withColumn("bucket", document_bucket(F.col("symbol")))
    last = Window.partitionBy("model", "run_date", "symbol").orderBy(F.col("meta.analysis_date").desc_nulls_last())
    one = keyed.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
    store.replace(one, path, ["model", "run_date", "bucket"], ["model", "run_date", "symbol"], fmt)


def write_days(rows: DataFrame, path: str, stamp: Column) -> None:
    """Parquet by ``crawl_date``, as ``landing.read_days`` takes it. The days of ``rows`` replace those that are there."""
    store.write(rows.withColumn("crawl_date", stamp), path, ["crawl_date"])
