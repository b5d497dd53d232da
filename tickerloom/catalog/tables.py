"""The supplied tables in the roles the operators expect.

``events`` is the labelled news feed, ``documents`` the article text,
``customer`` the symbols, ``nation`` their sectors, ``orders`` the grades and
price targets, ``lineitem`` the statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.functions.text import title_of

# The feed's five labels and one it never uses, to show zero-filled shares.
FEED_LABELS = ["view", "click", "purchase", "signup", "error", "refund"]
GRADES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NOISE = ["license", "all rights reserved"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled news rows."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("symbol"),
        F.col("event_id").alias("id"),
        F.col("ts").alias("date"),
        F.concat(F.col("event_type"), F.lit(" #"), F.col("event_id").cast("string"), F.lit(" "), F.col("props")).alias("title"),
        F.concat(F.lit("https://news.example/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("url"),
        F.col("event_type").alias("sentiment"),
        F.col("value").alias("score"),
        "props",
    )


FEED_SQL = """feed AS (
  SELECT user_id AS symbol, event_id AS id, ts AS date,
         event_type || ' #' || event_id || ' ' || props AS title,
         'https://news.example/' || user_id || '/' || event_id AS url,
         event_type AS sentiment, value AS score, props
  FROM events)"""

RECENT_SQL = FEED_SQL + """,
recent AS (
  SELECT f.* FROM feed f JOIN (SELECT symbol, max(date) AS mx FROM feed GROUP BY symbol) m USING (symbol)
  WHERE CAST(f.date AS DATE) >= CAST(m.mx AS DATE) - 2)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows as landed: the date is text, some of it unreadable."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("ticker"),
        title_of(F.col("text")).alias("title"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 35 + 1).cast("string"), 2, "0"), F.lit(" 10:30:00")).alias("date"),
        F.when(F.contains("text", F.lit("\n")), F.substring(F.col("text"), F.instr("text", "\n") + 1, F.length("text"))).alias("content"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("url"),
        "lang",
    )


# Same rows in SQL. A text without a line break has a title and no content.
ARTICLES_SQL = r"""articles AS (
  SELECT doc_id AS id, source AS ticker, split_part(text, chr(10), 1) AS title,
         '2024-01-' || lpad(CAST(doc_id % 35 + 1 AS VARCHAR), 2, '0') || ' 10:30:00' AS date,
         CASE WHEN contains(text, chr(10)) THEN substring(text, instr(text, chr(10)) + 1) END AS content,
         'https://news.example/' || doc_id AS url, lang
  FROM documents)"""

# Blanks as one character class, for both engines.
SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped_sql(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{SPACE_SQL}+|{SPACE_SQL}+\z', '', 'g')"


def collapsed_sql(expr: str) -> str:
    return stripped_sql(f"regexp_replace(coalesce({expr}, ''), '{SPACE_SQL}+', ' ', 'g')")


def any_word_sql(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), '{w.lower()}')" for w in words) + ")"
