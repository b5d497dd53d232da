"""Crawl, collection and dashboard tables on small hand-written input."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from conftest import rows
from tickerloom.operators import fundamentals as fd
from tickerloom.plans import collection, crawl, dashboard


def test_crawl(spark):
    body = "<p>" + "word " * 50 + "</p>"
    items = spark.createDataFrame(
        [("A", "t1", "l1", datetime(2026, 4, 1, 9)), ("B", "t2", "l1", datetime(2026, 4, 1, 10)),
         ("A", "t3", "l2", datetime(2026, 4, 1, 9)), ("A", "old", "l1", datetime(2026, 3, 20)), ("A", "t5", "gone", datetime(2026, 4, 1))],
        "ticker string, title string, link string, date timestamp_ntz",
    )
    pages = spark.createDataFrame([("l1", "u1", body), ("l2", "u2", "<p>short</p>"), ("l3", "u3", body)], "link string, url string, html string")
    found = crawl.crawled_news(items, pages, datetime(2026, 4, 2, 12))
    assert sorted(rows(found, "ticker", "title", "url")) == [("A", "t1", "u1"), ("B", "t2", "u1")]
    assert {c for (c,) in rows(found, "content")} == {("word " * 50).strip()}


def responses(spark):
    consensus = lambda n: json.dumps([{"symbol": "AA", "buy": n, "unlisted": 1}])
    return spark.createDataFrame(
        [("AA", "grades_consensus", consensus(1), 1), ("AA", "grades_consensus", consensus(2), 2),
         ("AA", "dcf_valuation", '{"dcf": 3.5}', 1), ("AA", "ratings_snapshot", "[]", 1), ("AA", "owner_earnings", "<html>", 1),
         ("BB", "stock_grades", None, 1), (None, "treasury_rates", '[{"date": "d", "year10": 4.25}]', 1),
         (None, "treasury_rates", '[{"date": "d", "year10": 4.5}]', 2)],
        "symbol string, endpoint string, body string, at int",
    )


def test_collection(spark):
    sectors = spark.createDataFrame([("AA", "tech")], "symbol string, sector string")
    docs = collection.assemble(responses(spark), sectors, F.lit("2026-04-02T00:00:00Z"), descriptions={"dcf_valuation": "value"})
    by_symbol = {d.symbol: d for d in docs.collect()}
    aa = by_symbol["AA"]
    assert (aa.meta.sector, aa.meta.api_version, by_symbol["BB"].meta.sector) == ("tech", "v3", "")
    assert aa.analyst.grades_consensus.data[0].buy == 2
    assert (aa.valuation.dcf_valuation.description, aa.valuation.dcf_valuation.data[0].dcf) == ("value", 3.5)
    assert {d.market_context.treasury_rates.data[0].year10 for d in by_symbol.values()} == {4.5}
    assert dict(rows(fd.ok_counts(docs), "symbol", "ok")) == {"AA": 3, "BB": 1}
    assert sum(len(docs.schema[s].dataType) for s in fd.SECTION_NAMES) == 19


def test_collection_skips_finished_symbols(spark):
    left = collection.new_responses(responses(spark), spark.createDataFrame([("AA",)], "symbol string"))
    assert sorted({s or "" for (s,) in rows(left, "symbol")}) == ["", "BB"]


def test_dashboard_of_analyses(spark):
    analyses = spark.createDataFrame(
        [("AA", "[긍정 요인]\n* **up** & on\n[부정 요인]\n\n[투자 판단]\n비투자"), ("BB", "")], "symbol string, investment_judgment string"
    )
    assert sorted(rows(dashboard.verdicts(analyses))) == [("AA", "no", True), ("BB", "hold", False)]
    assert sorted(rows(dashboard.section_cards(analyses))) == [
        ("AA", "긍정 요인", "positive", "• <strong>up</strong> &amp; on"), ("AA", "투자 판단", "plain", "비투자"),
    ]


def test_dashboard_of_fundamentals(spark):
    grades = [{"symbol": "AA", "date": "2026-04-01", "previousGrade": "Hold", "newGrade": "Buy", "action": "Upgrade"},
              {"symbol": "AA", "date": "bad", "newGrade": "Sell", "action": "other"}]
    sections = {"analyst": {
        "grades_consensus": {"buy": "bigint", "hold": "bigint", "sell": "bigint", "strongBuy": "bigint", "strongSell": "bigint"},
        "stock_grades": {"symbol": "string", "date": "string", "previousGrade": "string", "newGrade": "string", "action": "string"},
    }}
    raw = spark.createDataFrame(
        [("AA", "grades_consensus", '[{"buy": 3, "hold": 1}]', 1), ("AA", "stock_grades", json.dumps(grades), 1), ("BB", "stock_grades", "[]", 1)],
        "symbol string, endpoint string, body string, at int",
    )
    sectors = spark.createDataFrame([], "symbol string, sector string")
    docs = collection.assemble(raw, sectors, F.lit("now"), sections=sections, shared=())
    assert rows(dashboard.grade_bars(docs)) == [
        ("AA", "Strong Buy", 0, 0), ("AA", "Buy", 3, 75), ("AA", "Hold", 1, 25), ("AA", "Sell", 0, 0), ("AA", "Strong Sell", 0, 0),
    ]
    changes = dashboard.grade_change_rows(docs).orderBy("place")
    assert changes.columns == ["symbol", "place", "날짜", "이전 등급", "현재 등급", "변경"]
    assert rows(changes) == [("AA", 0, "2026-04-01", "Hold", "Buy", "🟢 상향"), ("AA", 1, None, None, "Sell", "other")]


def test_dashboard_of_labels(spark):
    news = spark.createDataFrame(
        [("AA", datetime(2026, 4, 1, 9, 5), "Growth", "a<b", "", None, "u1"), ("AA", datetime(2026, 4, 2, 8), "Risk", "c", "번역", " text ", "u2")],
        "symbol string, date timestamp_ntz, sentiment string, title string, title_ko string, content string, url string",
    )
    assert rows(dashboard.news_feed(news)) == [
        ("AA", "리스크", "2026.04.02  08:00", "번역", "text", "u2"),
        ("AA", "성장 기대", "2026.04.01  09:05", "a&lt;b", None, "u1"),
    ]
    assert [u for (u,) in rows(dashboard.news_feed(news, ["Growth"], False), "url")] == ["u1"]
    cards = {label: (shown, n, pct) for _, label, n, _, pct, shown in rows(dashboard.label_cards(news))}
    assert cards["Growth"] == ("성장 기대", 1, 50) and cards["Mixed"] == ("혼재", 0, 0)
    trend = rows(dashboard.daily_trend(news).orderBy("day"), "day", "Growth", "Risk", "Mixed")
    assert trend == [(date(2026, 4, 1), 1, None, None), (date(2026, 4, 2), None, 1, None)]
