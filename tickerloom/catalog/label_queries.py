"""Recency window and label statistics over the feed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tickerloom.catalog.tables import FEED_LABELS, FEED_SQL, RECENT_SQL, feed, table
from tickerloom.functions import values as v
from tickerloom.operators import labels as lb, news as nw, ordering as od
from tickerloom.plans import label_store
from tickerloom.session import durable_path

AS_OF = datetime(2024, 1, 16, 9, 30, 15)
LABEL_NAMES = {"view": "조회", "click": "클릭", "purchase": "구매", "signup": "가입"}


def _counts(spark, sf):
    return nw.daily_counts(feed(spark, sf))


def _recent_counts(spark, sf):
    return nw.recent_days(_counts(spark, sf))


def recent_window(spark, sf):
    return nw.recent_window(feed(spark, sf)).select(
        "symbol", "id", v.clock_text(F.col("date")).alias("date"), "sentiment", "score"
    )


def window_retention(spark, sf):
    return nw.window_retention(_counts(spark, sf))


def news_period(spark, sf):
    return lb.news_period(_recent_counts(spark, sf))


def news_projection(spark, sf):
    return feed(spark, sf).select(
        F.lit("feed").alias("origin"), v.clock_text(F.col("date")).alias("date"),
        v.day_text(F.col("date")).alias("date_only"), "title", "url", "sentiment",
    )


def label_counts(spark, sf):
    return lb.label_counts(_recent_counts(spark, sf))


def label_share(spark, sf):
    return lb.label_shares(_recent_counts(spark, sf), FEED_LABELS)


def label_share_int(spark, sf):
    shares = lb.label_shares(_counts(spark, sf), FEED_LABELS, digits=0)
    return shares.withColumn("pct", F.col("pct").cast("bigint"))


def label_map(spark, sf):
    return lb.label_map(_recent_counts(spark, sf)).withColumn("sentiment_summary", F.to_json("sentiment_summary"))


def day_label_counts(spark, sf):
    return _counts(spark, sf).withColumn("day", v.day_text(F.col("day"))).drop("newest")


def day_label_pivot(spark, sf):
    return lb.day_pivot(_counts(spark, sf), FEED_LABELS).withColumn("day", v.day_text(F.col("day")))


def day_label_map(spark, sf):
    return lb.day_label_map(_recent_counts(spark, sf)).withColumn("sentiment_by_date", F.to_json("sentiment_by_date"))


def mean_score(spark, sf):
    return lb.mean_score(feed(spark, sf), "symbol", "score")


def label_filter_sorted(spark, sf):
    chosen = nw.with_labels(feed(spark, sf), "sentiment", ["purchase", "error"])
    return chosen.select("symbol", "id", v.clock_text(F.col("date")).alias("date"), "sentiment").orderBy(
        F.col("date").desc(), "id"
    )


def label_display_map(spark, sf):
    return feed(spark, sf).select("id", v.display(F.col("sentiment"), LABEL_NAMES).alias("shown"))


def latest_n_per_symbol(spark, sf):
    return od.latest_rows(feed(spark, sf), ["symbol"], [F.col("date").desc(), F.col("id")], 3).select(
        "symbol", "rec_no", "id", v.clock_text(F.col("date")).alias("date")
    )


def publish_window(spark, sf):
    rows = table(spark, sf, "events")
    return rows.where(v.in_publish_window(F.col("ts"), AS_OF)).select("event_id", v.clock_text(F.col("ts")).alias("date"))


def date_formats(spark, sf):
    ts = F.col("date")
    return feed(spark, sf).select(
        "id", v.day_text(ts).alias("day"), v.dotted_text(ts).alias("dotted"), v.stamp_text(ts).alias("stamp"),
        v.month_text(v.day_text(ts)).alias("month"),
    )


def _stored(spark, sf):
    """The feed landed as one file per nine symbols: some files cut short at first, then all of them whole."""
    path = durable_path(spark)
    news = feed(spark, sf).withColumn("file", F.concat(F.lit("feed_"), F.floor(F.col("symbol") / 9).cast("string"), F.lit(".csv")))
    label_store.land(news.where((F.col("symbol") % 2 == 0) & (F.col("score") < 20)), path, F.col("score"))
    label_store.land(news, path, F.col("score"))
    return path


def stored_label_share(spark, sf):
    shares = lb.label_shares(label_store.daily(spark, _stored(spark, sf)), FEED_LABELS, digits=0)
    return shares.withColumns({"symbol": F.col("symbol").cast("bigint"), "pct": F.col("pct").cast("bigint")})


def stored_mean_score(spark, sf):
    return label_store.mean_scores(spark, _stored(spark, sf)).withColumn("symbol", F.col("symbol").cast("bigint"))


QUERIES = {
    f.__name__: f
    for f in [
        recent_window, window_retention, news_period, news_projection, label_counts, label_share,
        label_share_int, label_map, day_label_counts, day_label_pivot, day_label_map, mean_score,
        label_filter_sorted, label_display_map, latest_n_per_symbol, publish_window, date_formats,
        stored_label_share, stored_mean_score,
    ]
}

_SPINE = "(SELECT unnest(['" + "','".join(FEED_LABELS) + "']) AS label)"
_SHARES = """
SELECT s.symbol, s.label, coalesce(c.n, 0) AS n, s.total,
       {pct} AS pct
FROM (SELECT symbol, label, total FROM (SELECT symbol, count(*) AS total FROM {rows} GROUP BY symbol) t, {spine} l) s
LEFT JOIN (SELECT symbol, sentiment AS label, count(*) AS n FROM {rows} GROUP BY ALL) c
  ON c.symbol = s.symbol AND c.label = s.label"""
_PCT = "coalesce(c.n, 0) / s.total * 100"

SQL = {
    "recent_window": f"""WITH {RECENT_SQL}
SELECT symbol, id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, sentiment, score FROM recent""",
    "window_retention": f"""WITH {RECENT_SQL}
SELECT a.symbol, a.n AS n_all, r.n AS n_recent
FROM (SELECT symbol, count(*) AS n FROM feed GROUP BY symbol) a
JOIN (SELECT symbol, count(*) AS n FROM recent GROUP BY symbol) r USING (symbol)""",
    "news_period": f"""WITH {RECENT_SQL}
SELECT symbol, count(*) AS news_count, strftime(min(date), '%Y-%m-%d') AS first_day,
       strftime(max(date), '%Y-%m-%d') AS last_day,
       strftime(min(date), '%Y-%m-%d') || ' ~ ' || strftime(max(date), '%Y-%m-%d') AS news_period
FROM recent GROUP BY symbol""",
    "news_projection": f"""WITH {FEED_SQL}
SELECT 'feed' AS origin, strftime(date, '%Y-%m-%d %H:%M:%S') AS date,
       strftime(date, '%Y-%m-%d') AS date_only, title, url, sentiment FROM feed""",
    "label_counts": f"""WITH {RECENT_SQL}
SELECT symbol, sentiment AS label, count(*) AS n FROM recent GROUP BY ALL""",
    "label_share": f"WITH {RECENT_SQL}" + _SHARES.format(
        rows="recent", spine=_SPINE, pct=f"CAST(printf('%.1f', {_PCT}) AS DOUBLE)"),
    "label_share_int": f"WITH {FEED_SQL}" + _SHARES.format(
        rows="feed", spine=_SPINE, pct=f"CAST(printf('%.0f', {_PCT}) AS BIGINT)"),
    "label_map": f"""WITH {RECENT_SQL}
SELECT symbol, '{{' || string_agg('"' || sentiment || '":' || n, ',' ORDER BY n DESC, newest DESC, sentiment) || '}}' AS sentiment_summary
FROM (SELECT symbol, sentiment, count(*) AS n, max(date) AS newest FROM recent GROUP BY ALL) GROUP BY symbol""",
    "day_label_counts": f"""WITH {FEED_SQL}
SELECT symbol, strftime(date, '%Y-%m-%d') AS day, sentiment AS label, count(*) AS n FROM feed GROUP BY ALL""",
    "day_label_pivot": f"""WITH {FEED_SQL}
SELECT symbol, strftime(date, '%Y-%m-%d') AS day, """ + ", ".join(
        f"nullif(count(*) FILTER (sentiment = '{x}'), 0) AS {x}" for x in FEED_LABELS) + " FROM feed GROUP BY ALL",
    "day_label_map": f"""WITH {RECENT_SQL},
per_day AS (
  SELECT symbol, day, '{{' || string_agg('"' || sentiment || '":' || n, ',' ORDER BY n DESC, newest DESC, sentiment) || '}}' AS m
  FROM (SELECT symbol, strftime(date, '%Y-%m-%d') AS day, sentiment, count(*) AS n, max(date) AS newest FROM recent GROUP BY ALL)
  GROUP BY symbol, day)
SELECT symbol, '{{' || string_agg('"' || day || '":' || m, ',' ORDER BY day) || '}}' AS sentiment_by_date
FROM per_day GROUP BY symbol""",
    "mean_score": f"""WITH {FEED_SQL}
SELECT symbol, count(score) AS n, CAST(printf('%.3f', CAST(sum(CAST(score AS DECIMAL(28,6))) AS DOUBLE) / count(score)) AS DOUBLE) AS mean_score FROM feed GROUP BY symbol""",
    "label_filter_sorted": f"""WITH {FEED_SQL}
SELECT symbol, id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, sentiment FROM feed
WHERE sentiment IN ('purchase', 'error') ORDER BY date DESC, id""",
    "label_display_map": f"""WITH {FEED_SQL}
SELECT id, CASE sentiment """ + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in LABEL_NAMES.items()) + """
       ELSE sentiment END AS shown FROM feed""",
    "latest_n_per_symbol": f"""WITH {FEED_SQL}
SELECT symbol, rec_no, id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date DESC, id) AS INTEGER) AS rec_no FROM feed)
WHERE rec_no <= 3""",
    "publish_window": """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-13 00:00:15' AND TIMESTAMP '2024-01-15 23:59:15'""",
    "date_formats": f"""WITH {FEED_SQL}
SELECT id, strftime(date, '%Y-%m-%d') AS day, strftime(date, '%Y.%m.%d  %H:%M') AS dotted,
       strftime(date, '%y%m%d') AS stamp, strftime(date, '%Y-%m') AS month FROM feed""",
}

# the store holds the whole feed once all files are landed
SQL |= {"stored_label_share": SQL["label_share_int"], "stored_mean_score": SQL["mean_score"]}
