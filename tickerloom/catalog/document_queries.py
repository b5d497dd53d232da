"""Digests, text blocks, prompts and analysis documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.tables import FEED_LABELS, RECENT_SQL, feed
from tickerloom.catalog.fundamental_queries import ANALYST_BLOCK_SQL, fundamentals
from tickerloom.functions import replies as rp
from tickerloom.operators import news as nw
from tickerloom.plans import documents as dc

TEMPLATE = "News:{news}\n\nLabels:\n{labels}\n\nAnalysts:\n{analysts}\n"


def _placed(spark, sf):
    return dc.place_articles(nw.recent_window(feed(spark, sf)))


def _counts(spark, sf):
    return nw.recent_days(nw.daily_counts(feed(spark, sf)))


def _contexts(spark, sf, placed):
    analysts = dc.analyst_blocks(fundamentals(spark, sf))
    return dc.symbol_contexts(placed, _counts(spark, sf), analysts, FEED_LABELS)


def _verdict_by_count():
    """Stand-in judge: compares two labels in the digest."""

    def make():
        def score(prompts):
            replies = []
            for prompt in prompts:
                lead = prompt.count("  [purchase]") - prompt.count("  [error]")
                word = "투자" if lead > 0 else "비투자" if lead < 0 else "보류"
                replies.append(f"[투자 판단]\n{word}\n[판단 근거]\n{lead}")
            return replies

        return score

    return make


def news_digest(spark, sf):
    return dc.news_blocks(_placed(spark, sf))


def sentiment_block(spark, sf):
    return dc.sentiment_blocks(_counts(spark, sf), FEED_LABELS)


def analyst_block(spark, sf):
    return dc.analyst_blocks(fundamentals(spark, sf))


def symbol_context(spark, sf):
    contexts = _contexts(spark, sf, _placed(spark, sf))
    return contexts.select("symbol", dc.fill_template(TEMPLATE).alias("prompt"))


def symbol_judgment(spark, sf):
    judged = dc.judge(_contexts(spark, sf, _placed(spark, sf)), _verdict_by_count(), TEMPLATE)
    return judged.select("symbol", rp.verdict(F.col("judgment")).alias("verdict"), "judgment_error")


def analysis_document(spark, sf):
    placed = _placed(spark, sf)
    judged = dc.judge(_contexts(spark, sf, placed), _verdict_by_count(), TEMPLATE)
    docs = dc.analysis_documents(placed, _counts(spark, sf), judged, "counts-v1", "2024-02-01")
    return docs.select(
        "symbol", "meta.analysis_date", "investment_judgment", "meta.news_period", "meta.news_count", "meta.model",
        F.to_json("sentiment_summary").alias("sentiment_summary"),
        F.to_json("sentiment_by_date").alias("sentiment_by_date"),
        F.to_json("news_with_sentiment").alias("news_with_sentiment"),
        "analyst_context.news_block", "analyst_context.sentiment_block", "analyst_context.analyst_block",
    )


QUERIES = {
    f.__name__: f
    for f in [news_digest, sentiment_block, analyst_block, symbol_context, symbol_judgment, analysis_document]
}

_NL = "chr(10)"
_DIGEST = f"""{RECENT_SQL},
ranked AS (
  SELECT *, strftime(date, '%Y-%m-%d') AS day,
         row_number() OVER (PARTITION BY symbol, CAST(date AS DATE) ORDER BY date DESC, id) AS in_day FROM recent),
digest AS (
  SELECT symbol, string_agg(
           CASE WHEN in_day = 1 THEN {_NL} || '── ' || day || ' ──' || {_NL} ELSE '' END
           || '  [' || sentiment || '] ' || title, {_NL} ORDER BY day, in_day) AS news_block,
         sum(CASE sentiment WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS lead
  FROM ranked GROUP BY symbol)"""
_LABEL_ROWS = " UNION ALL ".join(f"SELECT '{x}' AS label, {i} AS place" for i, x in enumerate(FEED_LABELS))
_SENTIMENT = f"""totals AS (SELECT symbol, count(*) AS total FROM recent GROUP BY symbol),
tally AS (SELECT symbol, sentiment AS label, count(*) AS n, max(date) AS newest FROM recent GROUP BY ALL),
bars AS (
  SELECT t.symbol, t.total, string_agg(
           '  ' || l.label || repeat(' ', greatest(10 - length(l.label), 0)) || ' ' || printf('%3d', coalesce(c.n, 0))
           || '건 (' || printf('%5.1f', coalesce(c.n, 0) / t.total * 100) || '%) '
           || repeat('█', CAST(floor(CAST(printf('%.1f', coalesce(c.n, 0) / t.total * 100) AS DOUBLE) / 5) AS INTEGER)),
           {_NL} ORDER BY l.place) AS bars
  FROM totals t CROSS JOIN ({_LABEL_ROWS}) l LEFT JOIN tally c ON c.symbol = t.symbol AND c.label = l.label
  GROUP BY t.symbol, t.total),
day_tally AS (SELECT symbol, strftime(date, '%Y-%m-%d') AS day, sentiment, count(*) AS n, max(date) AS newest FROM recent GROUP BY ALL),
day_lines AS (
  SELECT symbol, day, string_agg(sentiment || ':' || n, ', ' ORDER BY n DESC, newest DESC, sentiment) AS shown,
         '{{' || string_agg('"' || sentiment || '":' || n, ',' ORDER BY n DESC, newest DESC, sentiment) || '}}' AS m
  FROM day_tally GROUP BY symbol, day),
flow AS (
  SELECT symbol, string_agg('  ' || day || ': ' || shown, {_NL} ORDER BY day) AS flow,
         '{{' || string_agg('"' || day || '":' || m, ',' ORDER BY day) || '}}' AS sentiment_by_date
  FROM day_lines GROUP BY symbol),
sblock AS (
  SELECT symbol, '총 뉴스 ' || total || '건 분석 결과:' || {_NL} || bars || {_NL} || {_NL} || '날짜별 감정 흐름:' || {_NL} || flow AS sentiment_block,
         sentiment_by_date
  FROM bars JOIN flow USING (symbol))"""
_CONTEXT = f"""{_DIGEST}, {_SENTIMENT}, {ANALYST_BLOCK_SQL},
context AS (
  SELECT d.symbol, d.news_block, d.lead, s.sentiment_block, s.sentiment_by_date, coalesce(a.analyst_block, '') AS analyst_block
  FROM digest d JOIN sblock s USING (symbol) LEFT JOIN ablock a USING (symbol))"""

SQL = {
    "news_digest": f"WITH {_DIGEST} SELECT symbol, news_block FROM digest",
    "sentiment_block": f"WITH {RECENT_SQL}, {_SENTIMENT} SELECT symbol, sentiment_block FROM sblock",
    "analyst_block": f"WITH {ANALYST_BLOCK_SQL} SELECT symbol, analyst_block FROM ablock",
    "symbol_context": f"""WITH {_CONTEXT}
SELECT symbol, 'News:' || news_block || {_NL} || {_NL} || 'Labels:' || {_NL} || sentiment_block
       || {_NL} || {_NL} || 'Analysts:' || {_NL} || analyst_block || {_NL} AS prompt FROM context""",
    "symbol_judgment": f"""WITH {_DIGEST}
SELECT symbol, CASE WHEN lead > 0 THEN 'yes' WHEN lead < 0 THEN 'no' ELSE 'hold' END AS verdict,
       NULL::VARCHAR AS judgment_error FROM digest""",
    "analysis_document": f"""WITH {_CONTEXT},
articles_json AS (
  SELECT symbol, '[' || string_agg(CAST(to_json(struct_pack(
           date := strftime(date, '%Y-%m-%d %H:%M:%S'), title := title, url := url, sentiment := sentiment)) AS VARCHAR),
           ',' ORDER BY date DESC, id) || ']' AS news_with_sentiment,
         strftime(min(date), '%Y-%m-%d') || ' ~ ' || strftime(max(date), '%Y-%m-%d') AS news_period, count(*) AS news_count
  FROM recent GROUP BY symbol),
summary AS (
  SELECT symbol, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY n DESC, newest DESC, label) || '}}' AS sentiment_summary
  FROM tally GROUP BY symbol)
SELECT symbol, '2024-02-01' AS analysis_date, '[투자 판단]' || {_NL}
       || CASE WHEN lead > 0 THEN '투자' WHEN lead < 0 THEN '비투자' ELSE '보류' END || {_NL} || '[판단 근거]' || {_NL} || lead AS investment_judgment,
       news_period, news_count, 'counts-v1' AS model, sentiment_summary, sentiment_by_date,
       news_with_sentiment, news_block, sentiment_block, analyst_block
FROM context JOIN articles_json USING (symbol) JOIN summary USING (symbol)""",
}
