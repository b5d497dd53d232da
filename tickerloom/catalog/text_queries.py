"""Cleaning, prompts and markup over documents, pages and conversations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tickerloom.catalog.tables import (
    ARTICLES_SQL, NOISE, SPACE_SQL, any_word_sql, articles, collapsed_sql, stripped_sql, table,
)
from tickerloom.constants import ARTICLE_CHARS, BODY_COLUMNS, BOILERPLATE_PATTERNS, SNIPPET_CHARS
from tickerloom.functions import text as tx, values as v
from tickerloom.functions.replies import read_label
from tickerloom.operators import news as nw
from tickerloom.operators.ledger import Ledger
from tickerloom.operators.scoring import classify, cue_scorer
from tickerloom.plans import crawl
from tickerloom.session import durable_path

# The site patterns, and two for the license lines the documents carry.
PATTERNS = [*BOILERPLATE_PATTERNS, r"This work is licensed under.*", r"All rights reserved.*"]
CRAWLED = datetime(2024, 1, 16, 12, 0)
CUES = {"Growth": ["erbleand"], "Risk": ["licens", "stion"], "Positive": ["eaux"], "Mixed": ["keit"]}


def valid_news(spark, sf):
    return nw.valid_news(articles(spark, sf)).select(
        "id", "ticker", "title", v.clock_text(F.col("date")).alias("date"), F.length("content").cast("bigint").alias("chars")
    )


def noise_filter(spark, sf):
    return nw.drop_noise(articles(spark, sf), NOISE).select(
        "id", "ticker", tx.is_noise(F.col("content"), NOISE).alias("title_only")
    )


def blocked_flag(spark, sf):
    return articles(spark, sf).select("id", tx.is_blocked(F.col("content"), NOISE).alias("blocked"))


def first_nonblank(spark, sf):
    rows = articles(spark, sf)
    offered = {
        "summary_ko": F.when(F.col("lang") == "de", F.lit("  ")),
        "content_ko": F.when(F.col("lang") == "fr", F.concat(F.lit(" fr: "), "title")),
        "content": F.col("content"),
        "text": F.col("title"),
    }
    title_ko = F.when(F.col("lang") == "es", F.concat(F.lit("es: "), "title")).otherwise(F.lit(""))
    return rows.select(
        "id",
        v.first_nonblank([offered[c] for c in BODY_COLUMNS if c in offered]).alias("body"),
        v.first_filled([title_ko, F.col("title")], "제목 없음").alias("heading"),
    )


def union_sources(spark, sf):
    rows = articles(spark, sf)
    raw = rows.where(F.col("lang") == "en").select("ticker", "title", "url")
    translated = rows.where(F.col("lang") != "en").select("id", "ticker", "title", "url")
    return nw.union_sources(raw, translated).select("id", "ticker", "title", "url")


def collapse_ws(spark, sf):
    return articles(spark, sf).select("id", tx.collapse_spaces(F.col("content")).alias("cleaned"))


def boilerplate_strip(spark, sf):
    cleaned = table(spark, sf, "documents").select("doc_id", tx.strip_boilerplate(F.col("text"), PATTERNS).alias("whole"))
    return cleaned.select(
        "doc_id", tx.article_head(F.col("whole"), ARTICLE_CHARS).alias("content_cleaned"),
        F.length("whole").cast("bigint").alias("whole_chars"), F.md5("whole").alias("whole_md5"),
    )


def prompt_input(spark, sf):
    rows = articles(spark, sf)
    body = F.coalesce("content", F.lit(""))
    title_only = (body == "") | tx.is_blocked(body, NOISE)
    return rows.select("id", tx.classifier_input(F.col("title"), body, title_only, SNIPPET_CHARS).alias("prompt"))


def label_normalise(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = table(spark, sf, "labels")
    reply = (
        F.when(F.col("toxic") == 1, F.lit("NEUTRAL, no: risk"))
        .when(F.col("quality") == 1, F.lit("**Growth**."))
        .when(F.col("quality") == 0, F.concat(F.lit("it is mi.xed "), "text"))
        .otherwise(F.col("text"))
    )
    return docs.join(known, "doc_id", "left").select("doc_id", read_label(reply).alias("label"))


def _prompted(spark, sf):
    rows = articles(spark, sf)
    body = F.coalesce("content", F.lit(""))
    title_only = (body == "") | tx.is_blocked(body, NOISE)
    return rows.select("id", "ticker", tx.classifier_input(F.col("title"), body, title_only, SNIPPET_CHARS).alias("prompt"))


def cue_label(spark, sf):
    prompted = _prompted(spark, sf).select("id", "prompt")
    return classify(prompted, F.col("prompt"), cue_scorer(CUES)).select("id", "sentiment", "error")


def ledger_label(spark, sf):
    """Labels through an answer ledger: a first run over one ticker's articles, then one over all, which asks only what is left."""
    prompted, ledger = _prompted(spark, sf), Ledger(durable_path(spark), "cues")
    first = prompted.agg(F.min("ticker")).scalar()
    classify(prompted.where(F.col("ticker") == first), F.col("prompt"), cue_scorer(CUES), ledger=ledger)
    labelled = classify(prompted, F.col("prompt"), cue_scorer(CUES), ledger=ledger)
    asked = ledger.entries(spark).agg(F.count("*")).scalar()
    return labelled.select("id", "sentiment", "error", asked.alias("asked"))


def page_paragraphs(spark, sf):
    kept = nw.keep_articles(table(spark, sf, "pages"))
    return kept.select("page_id", F.length("content").cast("bigint").alias("chars"), "content")


def crawled_news(spark, sf):
    """Feed items are events; forty in a row lead to the same page."""
    items = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("ticker"), F.col("event_type").alias("title"),
        F.floor(F.col("event_id") / 40).alias("link"), F.col("ts").alias("date"),
    )
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("link"), "url", "html")
    return crawl.crawled_news(items, pages, CRAWLED).withColumn("date", v.clock_text(F.col("date")))


def html_escape(spark, sf):
    said = F.concat(F.lit("<"), "role", F.lit(" id=\"c&"), F.col("conv_id").cast("string"), F.lit("\"> it's "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.escape_html(said).alias("html"))


def markdown_to_html(spark, sf):
    first = F.substring_index("text", " ", 1)
    said = F.concat(
        F.lit("## "), "role", F.lit("\n ["), "role", F.lit("] \n---\n***"), first, F.lit("*** and **"), first,
        F.lit("** or *"), first, F.lit("*\n* it's <b>\n** two\n\n\n\n"), "text", F.lit("\n--\n"),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.markdown_to_html(said).alias("html"))


QUERIES = {
    f.__name__: f
    for f in [
        valid_news, noise_filter, blocked_flag, first_nonblank, union_sources, collapse_ws,
        boilerplate_strip, prompt_input, label_normalise, cue_label, ledger_label, page_paragraphs, crawled_news, html_escape,
        markdown_to_html,
    ]
}


def _chain(expr: str, steps) -> str:
    for pattern, replacement in steps:
        pattern, replacement = pattern.replace("'", "''"), replacement.replace("'", "''")
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return expr


def _escaped(expr: str) -> str:
    for plain, code in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")]:
        expr = f"replace({expr}, '{plain}', '{code}')"
    return expr


_BODY = "coalesce(content, '')"
_PROMPT = (
    f"CASE WHEN {_BODY} = '' OR {any_word_sql(_BODY, NOISE)} THEN '제목: ' || title "
    f"ELSE '제목: ' || title || chr(10) || chr(10) || '본문:' || chr(10) || substring({_BODY}, 1, 800) END"
)
_BOILERPLATE = stripped_sql(
    "regexp_replace("
    + _chain("coalesce(text, '')", [("(?is)" + p.replace(r"\d", r"\p{Nd}"), "") for p in PATTERNS])
    + f", '{SPACE_SQL}{{3,}}', chr(10) || chr(10), 'g')"
)
_S = SPACE_SQL
_MARKDOWN = _chain(_escaped("said"), [
    (rf"(?m)^{_S}*-{{2,}}{_S}*$", ""),
    (rf"#{{1,6}}{_S}*", ""),
    (rf"(?m)^{_S}*\[.+?\]{_S}*$", ""),
    (r"\*\*\*(.+?)\*\*\*", r"<strong><em>\1</em></strong>"),
    (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"),
    (rf"(?m)^\*{{1,2}}{_S}+", "• "),
    (r"\*(.+?)\*", r"<em>\1</em>"),
    (r"\n{3,}", "\n\n"),
    (r"\n", "<br>"),
])
_ENDS = (
    "p|address|article|aside|blockquote|body|div|dl|fieldset|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|pre|"
    "section|table|td|th|tr|ul"
)


def _unescaped(expr: str) -> str:
    for code, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        expr = f"replace({expr}, '{code}', '{char}')"
    return expr


_PAGE_TEXT = rf"""cut AS (
  SELECT page_id, string_split_regex(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'),
         '(?i)<p(?:\s[^>]*)?>')[2:] AS pieces FROM pages),
plain AS (
  SELECT page_id, list_transform(pieces, lambda t: {_unescaped(f"regexp_replace(string_split_regex(t, '(?i)</?(?:{_ENDS})(?:[{chr(92)}s/][^>]*)?>')[1], '<[^>]*>', '', 'g')")}) AS texts FROM cut),
joined AS (
  SELECT page_id, coalesce(array_to_string(list_transform(list_filter(texts, lambda t: length(t) > 50),
         lambda t: {stripped_sql('t')}), ' '), '') AS content FROM plain)"""

SQL = {
    "valid_news": f"""WITH {ARTICLES_SQL}
SELECT id, ticker, title, strftime(TRY_CAST(date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS date,
       CAST(length({_BODY}) AS BIGINT) AS chars
FROM articles WHERE {stripped_sql('title')} NOT IN ('url', '') AND TRY_CAST(date AS TIMESTAMP) IS NOT NULL""",
    "noise_filter": f"""WITH {ARTICLES_SQL}
SELECT id, ticker, content IS NULL AS title_only FROM articles
WHERE NOT coalesce({any_word_sql('content', NOISE)}, false)""",
    "blocked_flag": f"""WITH {ARTICLES_SQL}
SELECT id, coalesce({any_word_sql('content', NOISE)}, false) AS blocked FROM articles""",
    "first_nonblank": f"""WITH {ARTICLES_SQL}
SELECT id,
       CASE WHEN lang = 'fr' THEN {stripped_sql("'fr: ' || title")}
            WHEN {stripped_sql(_BODY)} <> '' THEN {stripped_sql(_BODY)}
            ELSE nullif({stripped_sql('title')}, '') END AS body,
       CASE WHEN lang = 'es' THEN 'es: ' || title WHEN title <> '' THEN title ELSE '제목 없음' END AS heading
FROM articles""",
    "union_sources": f"""WITH {ARTICLES_SQL}
SELECT NULL::BIGINT AS id, ticker, title, url FROM articles WHERE lang = 'en'
UNION ALL SELECT id, ticker, title, url FROM articles WHERE lang <> 'en'""",
    "collapse_ws": f"WITH {ARTICLES_SQL} SELECT id, {collapsed_sql('content')} AS cleaned FROM articles",
    "boilerplate_strip": f"""
SELECT doc_id, substring(whole, 1, 3000) AS content_cleaned, CAST(length(whole) AS BIGINT) AS whole_chars, md5(whole) AS whole_md5
FROM (SELECT doc_id, {_BOILERPLATE} AS whole FROM documents)""",
    "prompt_input": f"WITH {ARTICLES_SQL} SELECT id, {_PROMPT} AS prompt FROM articles",
    "label_normalise": """
WITH replies AS (
  SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'NEUTRAL, no: risk' WHEN l.quality = 1 THEN '**Growth**.'
         WHEN l.quality = 0 THEN 'it is mi.xed ' || d.text
         ELSE d.text END AS reply
  FROM documents d LEFT JOIN labels l USING (doc_id)),
words AS (
  SELECT doc_id, list_transform(string_split_regex(regexp_replace(reply, '[^a-zA-Z\\s]', '', 'g'), '\\s+'),
         lambda w: upper(w[1]) || lower(w[2:])) AS ws FROM replies)
SELECT doc_id, coalesce(list_filter(ws, lambda w: w IN ('Positive', 'Growth', 'Neutral', 'Mixed', 'Risk', 'Negative'))[1], 'Neutral') AS label
FROM words""".replace("\\\\", "\\"),
    "cue_label": f"WITH {ARTICLES_SQL}, prompts AS (SELECT id, lower({_PROMPT}) AS p FROM articles) SELECT id, CASE "
    + " ".join(f"WHEN {' OR '.join(f'''contains(p, '{w}')''' for w in words)} THEN '{label}'" for label, words in CUES.items())
    + " ELSE 'Neutral' END AS sentiment, NULL::VARCHAR AS error FROM prompts",
    "page_paragraphs": f"""WITH {_PAGE_TEXT}
SELECT page_id, CAST(length(content) AS BIGINT) AS chars, content FROM joined WHERE length(content) > 200""",
    "crawled_news": f"""WITH {_PAGE_TEXT}
SELECT CAST(user_id AS VARCHAR) AS ticker, event_type AS title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, content, url
FROM joined JOIN events ON event_id // 40 = page_id JOIN pages USING (page_id)
WHERE length(content) > 200 AND ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-15 23:59:00'""",
    "html_escape": "SELECT conv_id, turn, " + _escaped(
        "('<' || role || ' id=\"c&' || conv_id || '\"> it''s ' || text)") + " AS html FROM conversations",
    "markdown_to_html": f"""
SELECT conv_id, turn, {_MARKDOWN} AS html FROM (
  SELECT conv_id, turn, '## ' || role || chr(10) || ' [' || role || '] ' || chr(10) || '---' || chr(10) || '***' || split_part(text, ' ', 1)
         || '*** and **' || split_part(text, ' ', 1) || '** or *' || split_part(text, ' ', 1) || '*' || chr(10) || '* it''s <b>' || chr(10)
         || '** two' || repeat(chr(10), 4) || text || chr(10) || '--' || chr(10) AS said FROM conversations)""",
}

# the same labels, and how often a model was asked: once per distinct prompt
SQL["ledger_label"] = (
    SQL["cue_label"].replace("SELECT id, lower(", f"SELECT id, {_PROMPT} AS prompt, lower(", 1)
    .replace("AS error FROM prompts", "AS error, (SELECT count(DISTINCT prompt) FROM prompts) AS asked FROM prompts")
)
