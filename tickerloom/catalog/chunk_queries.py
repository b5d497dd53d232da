"""Row ids, chunks, prompts and replies over documents."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tickerloom.catalog.tables import ARTICLES_SQL, SPACE_SQL, articles, collapsed_sql, stripped_sql, table
from tickerloom.constants import ARTICLE_CHARS, SECTIONS
from tickerloom.functions import replies as rp, text as tx
from tickerloom.operators import chunks as ch
from tickerloom.operators.replies import section_rows, with_analysis
from tickerloom.operators.scoring import analyse_articles, score_rows


def _ids(spark, sf):
    return articles(spark, sf).select("ticker", "id")


def row_ids(spark, sf):
    return ch.row_ids(_ids(spark, sf), "ticker", [F.col("id")], total="of_total").select(
        "ticker", "id", "row_id", "of_total"
    )


def chunk5(spark, sf):
    numbered = ch.with_chunks(ch.row_ids(_ids(spark, sf), "ticker", [F.col("id")]))
    return numbered.groupBy("ticker", "chunk").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def _prompts(spark, sf):
    return ch.chunk_prompts(articles(spark, sf).withColumn("content", F.coalesce("content", F.lit(""))))


def chunk_prompt(spark, sf):
    return _prompts(spark, sf).select("ticker", "chunk", "prompt")


def _echo_translator():
    """Stand-in translator: marks titles, returns bodies as they are,
    leaves out the second item of every third chunk."""

    def make():
        line = re.compile(r"^\[ID:(\d+)\] 날짜: .*? \| 제목: (.*?) \| 본문: (.*)$", re.M)

        def score(prompts):
            replies = []
            for prompt in prompts:
                items = [
                    {"id": int(i), "title": "ko: " + title, "content": body}
                    for i, title, body in line.findall(prompt)
                ]
                items = [item for item in items if not (item["id"] // 5 % 3 == 1 and item["id"] % 5 == 1)]
                replies.append("```json\n" + json.dumps(items, ensure_ascii=False) + "\n```")
            return replies

        return score

    return make


def _replied(spark, sf):
    return score_rows(_prompts(spark, sf), F.col("prompt"), _echo_translator())


def positional_zip(spark, sf):
    return ch.zip_replies(_replied(spark, sf)).select(
        "id", "ticker", "date", F.length("content").cast("bigint").alias("chars"), "title", "url"
    )


def reply_id_join(spark, sf):
    return ch.match_replies(_replied(spark, sf)).select(
        "id", "ticker", "date", F.length("content").cast("bigint").alias("chars"), "title", "url"
    )


def reply_unanswered(spark, sf):
    return ch.unanswered(_replied(spark, sf))


def _article_replies(spark, sf):
    """Article replies in the ways they arrive: fenced, bare, cut off, with
    text behind, or lacking fields."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    rows = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    score = F.when(F.col("toxic") == 1, F.lit("-0.75")).when(F.col("quality") == 1, F.lit("0.5")).otherwise(F.lit("0"))
    whole = F.concat(
        F.lit('{"summary_ko": "'), F.col("source"), F.lit('", "sentiment": "'),
        F.when(F.col("quality") == 1, F.lit("긍정")).otherwise(F.lit("중립")),
        F.lit('", "score": '), score, F.lit(', "keywords": ["'), F.col("lang"), F.lit('", "'), F.col("source"),
        F.lit('"], "impact": "'), F.col("lang"), F.lit('"}'),
    )
    kind = F.col("doc_id") % 6
    return rows.select(
        "doc_id",
        F.when(kind == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(kind == 1, whole)
        .when(kind == 2, F.concat(whole, F.lit(" Hope this helps.")))
        .when(kind == 3, F.regexp_replace(whole, r'"\],.*$', ""))
        .when(kind == 4, F.concat(F.lit('{"sentiment": "'), F.col("lang"), F.lit('"}')))
        .otherwise(F.col("text")).alias("reply"),
    )


def reply_parse(spark, sf):
    return with_analysis(_article_replies(spark, sf), F.col("reply")).drop("reply")


def _stand_in_analyst():
    """Stand-in article model: reads mood and score off the text's length and
    letters, fails on some texts, answers others without JSON."""

    def make():
        def score(prompts):
            if any("licens" in p for p in prompts):
                raise ValueError("refused")
            return [
                "no JSON here" if len(p) % 7 == 0 else "```json\n" + json.dumps({
                    "summary_ko": p[:10], "sentiment": "긍정" if "tion" in p else "부정", "score": len(p) % 9 / 4 - 1,
                    "keywords": [str(len(p)), "n"],
                }, ensure_ascii=False) + "\n```"
                for p in prompts
            ]

        return score

    return make


def article_analysis(spark, sf):
    cleaned = table(spark, sf, "documents").select(
        "doc_id", tx.article_head(tx.strip_boilerplate(F.col("text"), [r"All rights reserved.*"]), ARTICLE_CHARS).alias("content_cleaned")
    )
    analysed = analyse_articles(cleaned, F.col("content_cleaned"), _stand_in_analyst())
    return analysed.drop("content_cleaned")


def fence_strip(spark, sf):
    return _article_replies(spark, sf).select(
        "doc_id", rp.drop_fences(F.col("reply")).alias("no_fences"), rp.inside_fence(F.col("reply")).alias("inside")
    )


def _judgments(spark, sf):
    """Judgment texts with bold, spaced, missing and misplaced headings."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    rows = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    verdict = (
        F.when(F.col("toxic") == 1, F.lit("**비투자** 권고"))
        .when(F.col("quality") == 1, F.lit(" 투자"))
        .otherwise(F.lit("보류 [참고] 투자 아님"))
    )
    late = F.when(F.col("doc_id") % 7 == 0, F.lit("**[긍정 요인]**\n* early\n")).otherwise(F.lit(""))
    return rows.select("doc_id", F.concat(
        late, F.lit("**[ 핵심 요약 ]**\n* "), "text", F.lit("\n\n"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("[전체 흐름 분석]\n"), "source", F.lit(" 📈\n\n"))),
        F.lit("## [긍정 요인]\n* a\n\n[부정 요인]\n\n"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("[투자 판단]\n"), verdict, F.lit("\n\n[판단 근거]\n"), "text")),
    ).alias("judgment"))


def section_split(spark, sf):
    rows = section_rows(_judgments(spark, sf), "doc_id", "judgment")
    return rows.withColumn("tone", rp.card_tone(F.col("section")))


def verdict(spark, sf):
    return _judgments(spark, sf).select(
        "doc_id", rp.verdict(F.col("judgment")).alias("verdict"), rp.has_verdict(F.col("judgment")).alias("has_verdict")
    )


QUERIES = {
    f.__name__: f
    for f in [
        row_ids, chunk5, chunk_prompt, positional_zip, reply_id_join, reply_unanswered, reply_parse,
        article_analysis, fence_strip, section_split, verdict,
    ]
}

_NUMBERED = f"""{ARTICLES_SQL},
numbered AS (
  SELECT a.*, row_number() OVER (PARTITION BY ticker ORDER BY id) AS row_id,
         count(*) OVER (PARTITION BY ticker) AS of_total FROM articles a),
chunked AS (SELECT *, (row_id - 1) // 5 AS chunk, {collapsed_sql('content')} AS body FROM numbered)"""
# n-th remaining item of a chunk; the second of every third chunk is left out
_KEPT = f"""{_NUMBERED},
kept AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, chunk ORDER BY row_id) AS place FROM chunked
  WHERE NOT (chunk % 3 = 1 AND (row_id - 1) % 5 = 1)),
placed AS (SELECT *, row_number() OVER (PARTITION BY ticker, chunk ORDER BY row_id) AS place FROM chunked)"""

_ARTICLE_REPLIES = r"""
parts AS (
  SELECT doc_id, lang, source, text AS title, doc_id % 6 AS kind, quality, toxic,
         CASE WHEN toxic = 1 THEN -0.75 WHEN quality = 1 THEN 0.5 ELSE 0 END::DOUBLE AS score,
         CASE WHEN quality = 1 THEN '긍정' ELSE '중립' END AS mood
  FROM documents LEFT JOIN labels USING (doc_id))"""

_CLEANED = stripped_sql(
    f"regexp_replace(regexp_replace(text, '(?is)All rights reserved.*', '', 'g'), '{SPACE_SQL}{{3,}}', chr(10) || chr(10), 'g')"
)
_P = r"\*{0,2}\[\s*%s\s*\]\*{0,2}"


def _sections_sql() -> str:
    found = ",\n".join(
        f"regexp_extract(judgment, '{_P % name.replace(' ', chr(92) + ' ')}') AS m{i}" for i, name in enumerate(SECTIONS)
    )
    starts = ",\n".join(
        f"CASE WHEN m{i} <> '' THEN instr(judgment, m{i}) END AS s{i}" for i in range(len(SECTIONS))
    )
    pieces = []
    for i, name in enumerate(SECTIONS):
        nxt = ", ".join(f"s{j}" for j in range(i + 1, len(SECTIONS))) or "NULL"
        end = f"coalesce({nxt}, length(judgment) + 1)"
        begin = f"(s{i} + length(m{i}))"
        tone = "positive" if "긍정" in name else "negative" if "부정" in name else "plain"
        pieces.append(
            f"SELECT doc_id, '{name}' AS section, trim(substring(judgment, {begin}, greatest({end} - {begin}, 0)), "
            f"' ' || chr(10)) AS body, '{tone}' AS tone FROM starts WHERE s{i} IS NOT NULL"
        )
    return f"""WITH {_JUDGMENTS},
found AS (SELECT doc_id, judgment, {found} FROM judgments),
starts AS (SELECT *, {starts} FROM found)
""" + "\nUNION ALL ".join(pieces)


_JUDGMENTS = """judgments AS (
  SELECT doc_id,
    CASE WHEN doc_id % 7 = 0 THEN '**[긍정 요인]**' || chr(10) || '* early' || chr(10) ELSE '' END
    || '**[ 핵심 요약 ]**' || chr(10) || '* ' || text || chr(10) || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '[전체 흐름 분석]' || chr(10) || source || ' 📈' || chr(10) || chr(10) END
    || '## [긍정 요인]' || chr(10) || '* a' || chr(10) || chr(10) || '[부정 요인]' || chr(10) || chr(10)
    || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '[투자 판단]' || chr(10)
         || CASE WHEN toxic = 1 THEN '**비투자** 권고' WHEN quality = 1 THEN ' 투자' ELSE '보류 [참고] 투자 아님' END
         || chr(10) || chr(10) || '[판단 근거]' || chr(10) || text END AS judgment
  FROM documents LEFT JOIN labels USING (doc_id))"""

SQL = {
    "row_ids": f"WITH {_NUMBERED} SELECT ticker, id, row_id, of_total FROM numbered",
    "chunk5": f"""WITH {_NUMBERED}
SELECT ticker, chunk, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM chunked GROUP BY ticker, chunk""",
    "chunk_prompt": f"""WITH {_NUMBERED}
SELECT ticker, chunk, string_agg('[ID:' || (row_id - 1) || '] 날짜: ' || date || ' | 제목: ' || title || ' | 본문: ' || body,
       chr(10) ORDER BY row_id) AS prompt
FROM chunked GROUP BY ticker, chunk""",
    "positional_zip": f"""WITH {_KEPT}
SELECT p.row_id AS id, p.ticker, p.date, CAST(length(k.body) AS BIGINT) AS chars, 'ko: ' || k.title AS title, p.url
FROM placed p JOIN kept k ON p.ticker = k.ticker AND p.chunk = k.chunk AND p.place = k.place""",
    "reply_id_join": f"""WITH {_KEPT}
SELECT row_id AS id, ticker, date, CAST(length(body) AS BIGINT) AS chars, 'ko: ' || title AS title, url FROM kept""",
    "reply_unanswered": f"""WITH {_NUMBERED}
SELECT ticker, chunk, row_id FROM chunked WHERE chunk % 3 = 1 AND (row_id - 1) % 5 = 1""",
    "reply_parse": f"""WITH {_ARTICLE_REPLIES}
SELECT doc_id, CASE WHEN kind IN (0, 1) THEN source ELSE '' END AS summary_ko,
       CASE WHEN kind IN (0, 1) THEN mood WHEN kind = 4 THEN lang ELSE '분석실패' END AS sentiment,
       CASE WHEN kind IN (0, 1) THEN score ELSE 0 END::DOUBLE AS score,
       CASE WHEN kind IN (0, 1) THEN lang || ', ' || source ELSE '' END AS keywords,
       CASE WHEN kind IN (0, 1) THEN lang ELSE '' END AS impact
FROM parts""",
    "article_analysis": f"""
WITH cleaned AS (
  SELECT doc_id, substring({_CLEANED}, 1, 3000) AS c FROM documents),
kinds AS (SELECT *, CASE WHEN contains(c, 'licens') THEN '오류' WHEN length(c) % 7 = 0 THEN '분석실패' END AS failed FROM cleaned)
SELECT doc_id, CASE WHEN failed = '오류' THEN 'ValueError: refused' END AS error,
       CASE WHEN failed IS NULL THEN substring(c, 1, 10) ELSE '' END AS summary_ko,
       coalesce(failed, CASE WHEN contains(c, 'tion') THEN '긍정' ELSE '부정' END) AS sentiment,
       CASE WHEN failed IS NULL THEN length(c) % 9 / 4 - 1 ELSE 0 END::DOUBLE AS score,
       CASE WHEN failed IS NULL THEN length(c) || ', n' ELSE '' END AS keywords, '' AS impact
FROM kinds""",
    "fence_strip": f"""WITH {_ARTICLE_REPLIES},
whole AS (
  SELECT *, '{{"summary_ko": "' || source || '", "sentiment": "' || mood || '", "score": '
    || CASE WHEN toxic = 1 THEN '-0.75' WHEN quality = 1 THEN '0.5' ELSE '0' END
    || ', "keywords": ["' || lang || '", "' || source || '"], "impact": "' || lang || '"}}' AS w FROM parts),
replies AS (
  SELECT doc_id, CASE kind WHEN 0 THEN w WHEN 1 THEN w WHEN 2 THEN w || ' Hope this helps.'
    WHEN 3 THEN regexp_replace(w, '"\\],.*$', '') WHEN 4 THEN '{{"sentiment": "' || lang || '"}}' ELSE title END AS r,
    kind FROM whole)
SELECT doc_id, trim(r) AS no_fences, r AS inside FROM replies""",
    "section_split": _sections_sql(),
    "verdict": f"""WITH {_JUDGMENTS},
said AS (SELECT doc_id, judgment, regexp_extract(judgment, '\\[\\s*투자 판단\\s*\\]([^\\[]*)', 1) AS t FROM judgments)
SELECT doc_id, CASE WHEN contains(t, '비투자') THEN 'no' WHEN contains(t, '투자') THEN 'yes' ELSE 'hold' END AS verdict,
       regexp_matches(judgment, '\\[\\s*투자 판단\\s*\\]') AS has_verdict
FROM said""",
}
