"""Landed files in, result files out."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tickerloom import schemas
from tickerloom.constants import SHORT_ANALYST_ENDPOINTS
from tickerloom.operators import fundamentals as fd, lookups as lk, news as nw
from tickerloom.plans import documents as dc
from tickerloom.sources import landing, sinks, store
from tickerloom.streaming.landing import clean_landed

HEADER = "ticker,title,date,content,url\n"


@pytest.fixture
def news_folder(tmp_path):
    (tmp_path / "AA_260401.csv").write_text(
        "﻿" + HEADER
        + 'AA,"He said ""buy""",2026-04-01 10:00:00,"two\nlines, one field",u1\n'
        + "AA,url,2026-04-01 09:00:00,body,u2\n"
        + "AA,No date,soon,body,u3\n"
        + "AA,Empty,2026-03-31 08:00:00,,u4\n",
        encoding="utf-8",
    )
    (tmp_path / "AA_260402.csv").write_text(HEADER + "AA,Newer,2026-04-02 10:00:00,Access DENIED page,u5\n", encoding="utf-8")
    (tmp_path / "BB_260402.csv").write_text(HEADER + "BB,Other,2026-04-02 11:00:00,text,u6\n", encoding="utf-8")
    return str(tmp_path)


def test_news_csv(spark, news_folder):
    news = landing.read_news(spark, news_folder)
    assert news.count() == 6
    first = news.where("url = 'u1'").first()
    assert (first.ticker, first.title, first.content) == ("AA", 'He said "buy"', "two\nlines, one field")
    assert (first.file_symbol, first.file_stamp) == ("AA", "260401")


def test_valid_news_and_noise(spark, news_folder):
    valid = nw.valid_news(landing.read_news(spark, news_folder))
    found = sorted(rows(valid, "url", "content", "date"))
    assert found == [
        ("u1", "two\nlines, one field", datetime(2026, 4, 1, 10)), ("u4", "", datetime(2026, 3, 31, 8)),
        ("u5", "Access DENIED page", datetime(2026, 4, 2, 10)), ("u6", "text", datetime(2026, 4, 2, 11)),
    ]
    assert sorted(u for (u,) in rows(nw.drop_noise(valid), "url")) == ["u1", "u4", "u6"]


def test_latest_files(spark, news_folder, tmp_path):
    (tmp_path / "AA_260403_translated.csv").write_text(schemas.TRANSLATED_NEWS)
    for name in ["AA_analysis_m.json", "AA_analysis_m331.json", "AA_analysis_m_0401.json", "AA_analysis_m_0331.json"]:
        (tmp_path / name).write_text("{}")
    files = landing.list_files(spark, news_folder, "*").withColumn("symbol", F.regexp_extract("path", r"/([A-Z]+)_[^/]*$", 1))
    path = F.col("path")
    latest = lk.latest_paths(files, "symbol", "path", {
        "raw": F.endswith(path, F.lit(".csv")) & landing.is_raw_file(path), "doc": landing.is_dated_analysis(path, "m"),
    })
    short = lambda p: p and p.rsplit("/", 1)[1]
    assert {s: (short(r), short(d)) for s, r, d in rows(latest)} == {
        "AA": ("AA_260402.csv", "AA_analysis_m_0401.json"), "BB": ("BB_260402.csv", None),
    }


def test_partitioned_news_is_pruned(spark, news_folder, tmp_path):
    news = landing.read_news(spark, news_folder).withColumnRenamed("file_stamp", "crawl_date").drop("file", "file_symbol")
    target = str(tmp_path / "out")
    sinks.write_news(news, target)
    one = landing.read_partitioned(spark, target, "AA", "260402")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan and "DataFilters: []" in plan
    assert rows(one, "url") == [("u5",)]
    assert landing.read_partitioned(spark, target).count() == 6


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("AA", 'a "quoted", title', "2026-04-01 10:00:00", "x\ny", "u", "Growth")], schemas.LABELLED_NEWS
    )
    target = str(tmp_path / "csv")
    sinks.write_csv(df.coalesce(1), target)
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert part.read_bytes().startswith("﻿ticker,title".encode())
    back = landing.read_news(spark, target, schemas.LABELLED_NEWS)
    assert rows(back, *df.columns) == rows(df)


def test_document_sink_round_trip(spark, tmp_path):
    doc = {
        "meta": {"symbol": "AA", "news_period": "2026-04-01 ~ 2026-04-01", "news_count": 1, "model": "m"},
        "sentiment_summary": {"Growth": 1},
        "sentiment_by_date": {"2026-04-01": {"Growth": 1}},
        "news_with_sentiment": [{"date": "2026-04-01 10:00:00", "title": "한글", "url": "u", "sentiment": "Growth"}],
        "analyst_context": {"news_block": "\n── 2026-04-01 ──", "sentiment_block": "s", "analyst_block": ""},
        "investment_judgment": "[투자 판단] 보류",
    }
    (tmp_path / "AA.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2), encoding="utf-8")
    read = landing.read_analyses(spark, str(tmp_path / "AA.json")).drop("file")
    assert read.first().symbol == "AA" and read.first().sentiment_by_date == {"2026-04-01": {"Growth": 1}}
    dated = read.withColumn("meta", F.col("meta").withField("analysis_date", F.lit("2026-04-02T01:00:00")))
    for fmt in ("parquet", "json"):
        target = str(tmp_path / fmt)
        sinks.write_documents(dated, target, fmt)
        assert (tmp_path / fmt / "model=m" / "run_date=2026-04-02").exists()
        back = landing.read_documents(spark, target, fmt=fmt).drop("model", "run_date")
        assert [r.asDict(True) for r in back.collect()] == [r.asDict(True) for r in dated.select(back.columns).collect()]


def _documents(spark, symbols, model="m", at="2026-04-02T01:00:00", text="t"):
    rows = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    null = {n: F.lit(None).cast(t) for n, t in [("sentiment_summary", "map<string, bigint>"), ("sentiment_by_date", "map<string, map<string, bigint>>")]}
    return rows.select(
        "symbol",
        F.struct("symbol", F.lit(at).alias("analysis_date"), F.lit("p").alias("news_period"), F.lit(1).cast("long").alias("news_count"), F.lit(model).alias("model")).alias("meta"),
        *[c.alias(n) for n, c in null.items()],
        F.array(F.struct(*[F.lit("x\ny" + c).alias(c) for c in ("date", "title", "url", "sentiment")])).alias("news_with_sentiment"),
        F.struct(*[F.lit("b").alias(c) for c in ("news_block", "sentiment_block", "analyst_block")]).alias("analyst_context"),
        F.lit(text).alias("investment_judgment"),
    )


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_a_rerun_leaves_one_document_per_key(spark, tmp_path, fmt, monkeypatch):
    monkeypatch.setattr(sinks, "DOCUMENT_BUCKETS", 3)
    target = str(tmp_path / "docs")
    read = lambda **by: sorted(rows(landing.read_documents(spark, target, fmt=fmt, **by), "symbol", "model", "run_date", "investment_judgment"))
    assert read() == []
    symbols = [f"S{i:02}" for i in range(40)]
    sinks.write_documents(_documents(spark, symbols), target, fmt)
    sinks.write_documents(_documents(spark, symbols, model="other"), target, fmt)
    first = read()
    sinks.write_documents(_documents(spark, symbols), target, fmt)
    assert read() == first and len(first) == 80
    # some symbols anew, one of them twice in the run, and one more day
    twice = _documents(spark, ["S01"], text="old").union(_documents(spark, ["S01", "S39", "T"], at="2026-04-02T05:00:00", text="new"))
    sinks.write_documents(twice, target, fmt)
    sinks.write_documents(_documents(spark, ["S01"], at="2026-04-03T05:00:00", text="next"), target, fmt)
    new = {(s, "m", "2026-04-02", "new") for s in ("S01", "S39", "T")} | {("S01", "m", "2026-04-03", "next")}
    assert set(read()) == {r for r in first if r[:2] not in (("S01", "m"), ("S39", "m"))} | new
    assert len(read()) == 82
    assert read(symbol="S01", model="m", run_date="2026-04-02") == [("S01", "m", "2026-04-02", "new")]
    files = list((tmp_path / "docs" / "model=m" / "run_date=2026-04-02").rglob("part-*"))
    assert len(files) <= 3 * 2  # many documents a file
    sinks.write_documents(_documents(spark, []), target, fmt)
    assert len(read()) == 82


def test_rows_of_a_key_that_move_and_vanish(spark, tmp_path):
    """The table as a store by day of rows that files bring; a file landed again may have other days, or none."""
    path = str(tmp_path / "store")
    table = lambda *r: spark.createDataFrame(list(r), "file string, n int, day string")
    put = lambda files, *r: store.replace(table(*r), path, ["day"], ["file"], replaced=spark.createDataFrame([(f,) for f in files], "file string"))
    found = lambda: sorted(rows(store.read(spark, path, table().schema)))
    put("ab", ("a", 1, "d1"), ("a", 2, "d2"), ("b", 3, "d2"))
    untouched = next((tmp_path / "store" / "day=d2").glob("part-*")).name
    put("c", ("c", 4, "d3"))
    assert found() == [("a", 1, "d1"), ("a", 2, "d2"), ("b", 3, "d2"), ("c", 4, "d3")]
    assert next((tmp_path / "store" / "day=d2").glob("part-*")).name == untouched
    for _ in range(2):
        put("a", ("a", 5, "d3"))
        assert found() == [("a", 5, "d3"), ("b", 3, "d2"), ("c", 4, "d3")]
    assert not (tmp_path / "store" / "day=d1").exists()
    put("c")
    assert found() == [("a", 5, "d3"), ("b", 3, "d2")]


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    rows_ = spark.range(600).select(F.col("id"), (F.col("id") % 30).cast("string").alias("d"), F.lit("f").alias("file"))
    path = str(tmp_path / "days")
    sinks.write_days(rows_, path, F.concat(F.lit("2401"), F.lpad("d", 2, "0")))
    one = landing.read_days(spark, path, stamp="240107")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(crawl_date" in plan.replace("\n", " ") and "240107" in plan
    assert {f.rsplit("/", 2)[1] for f in one.inputFiles()} and one.count() == 20
    days = spark.createDataFrame([(f"2401{i:02}", i) for i in range(30)], "crawl_date string, n int").where("n > 26")
    several = landing.read_days(spark, path, days=days)
    assert several.count() == 60
    several.collect()
    plan = several._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    files = several.select(F.col("_metadata.file_path").alias("f")).distinct().count() if "_metadata" in several.columns else None
    assert files in (None, 3)


def test_digits_of_a_ticker_stay_text(spark, tmp_path):
    news = spark.createDataFrame([("005930", "t", "260402"), ("0700", "t", "260402")], "ticker string, title string, crawl_date string")
    target = str(tmp_path / "out")
    sinks.write_news(news, target)
    assert sorted(rows(landing.read_partitioned(spark, target), "ticker", "crawl_date")) == [("005930", "260402"), ("0700", "260402")]
    assert landing.read_partitioned(spark, target, "005930").count() == 1


def test_rows_of_the_newest_file(spark):
    news = spark.createDataFrame(
        [("A", "260401", "f1", 1), ("A", "260402", "f2", 2), ("A", "260402", "f2", 3), ("B", "260401", "f3", 4)],
        "file_symbol string, file_stamp string, file string, n int",
    )
    assert sorted(n for (n,) in rows(landing.newest_files(news), "n")) == [2, 3, 4]


def test_model_name_is_no_pattern(spark):
    df = spark.createDataFrame([("/d/A_analysis_m.1_0401.json",), ("/d/A_analysis_mx1_0401.json",)], "p string")
    assert [x for (x,) in rows(df, landing.is_dated_analysis(F.col("p"), "m.1"))] == [True, False]


FUNDAMENTALS = {
    "meta": {"symbol": "AA", "sector": "s", "collected_at": "t", "api_version": "v3"},
    "analyst": {
        "grades_consensus": {"description": "", "data": [{"symbol": "AA", "buy": 27, "hold": 12, "extra": 1}]},
        "price_target_consensus": {"description": "", "data": [{"targetHigh": 299, "targetLow": 223, "targetConsensus": 256.15}]},
        "analyst_estimates": {"description": "", "data": [{"date": "2030-12-31", "estimatedRevenueAvg": 7.25e10, "estimatedEpsAvg": 12.345}]},
        "stock_grades_historical": {"description": "", "data": None},
    },
    "fundamental": {"key_metrics_ttm": {"description": "", "data": []}},
    "valuation": {"dcf_valuation": {"description": "", "data": [{"symbol": "AA", "dcf": 163.59675411271115}]}},
    "market_context": {},
}


@pytest.fixture
def fundamentals_folder(tmp_path):
    (tmp_path / "AA.json").write_text(json.dumps(FUNDAMENTALS, indent=2))
    (tmp_path / "BB.json").write_text(json.dumps({"meta": {"symbol": "BB"}, "analyst": None}))
    return str(tmp_path)


def test_analyst_block(spark, fundamentals_folder):
    docs = landing.read_fundamentals(spark, fundamentals_folder)
    blocks = dict(rows(dc.analyst_blocks(docs)))
    assert blocks["AA"].split("\n") == [
        "▶ 애널리스트 등급 합산", "  Strong Buy: 0  Buy: 27  Hold: 12  Sell: 0  Strong Sell: 0",
        "▶ 목표주가 컨센서스", "  High: $299  Low: $223  Consensus: $256.15  Median: $N/A",
        "▶ 실적 추정치 (2030-12)", "  예상 매출: $72.5B  예상 EPS: $%.2f" % 12.345,
        "▶ DCF 내재가치", "  DCF: $163.59675411271115  현재가: $N/A",
    ]
    assert blocks["BB"] == ""
    short = dict(rows(dc.analyst_blocks(docs, endpoints=SHORT_ANALYST_ENDPOINTS)))
    assert [line[0] for line in short["AA"].split("\n")] == ["▶", " "] * 3
    assert "예상" not in short["AA"]


def test_ok_counts_and_flatten(spark, fundamentals_folder):
    docs = landing.read_fundamentals(spark, fundamentals_folder)
    assert sorted(rows(fd.ok_counts(docs))) == [("AA", 4, 19), ("BB", 0, 19)]
    flat = fd.flatten(docs)
    assert flat.count() == 38  # every endpoint keeps a row, with or without records
    kept = sorted(rows(flat.where("record is not null"), "symbol", "endpoint", "rec_no"))
    assert [k[1] for k in kept] == ["analyst_estimates", "dcf_valuation", "grades_consensus", "price_target_consensus"]
    first = fd.first_record(docs, "analyst", "grades_consensus")
    assert dict(rows(docs, "symbol", first["buy"])) == {"AA": 27, "BB": None}
    assert docs.select(fd.records(docs, "analyst", "no_such")).first()[0] == []


def test_declared_but_absent_fields(spark, fundamentals_folder):
    docs = landing.read_fundamentals(spark, fundamentals_folder)
    record = docs.select(fd.first_record(docs, "analyst", "price_target_consensus").alias("r"))
    assert {f: p for f, p, _ in rows(fd.field_coverage(record, "r"))} == {
        "symbol": 0, "targetHigh": 1, "targetLow": 1, "targetConsensus": 1, "targetMedian": 0,
    }


def test_run_summary(spark, fundamentals_folder):
    docs = landing.read_fundamentals(spark, fundamentals_folder)
    sectors = spark.createDataFrame([("AA", "tech")], "symbol string, sector string")
    done = spark.createDataFrame([("BB",), ("BB",)], "symbol string")
    found = fd.run_summary(fd.ok_counts(docs), sectors, docs.select("symbol", "size_bytes"), done, "symbol")
    assert sorted((r.symbol, r.sector, r.ok, r.total, r.size_kb, r.status) for r in found.collect()) == [
        ("AA", "tech", 4, 19, 1, "NEW"), ("BB", "", 0, 19, 0, "SKIP"),
    ]


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><title>c</title>"
        "<item><title>A &amp; B</title><link>http://x/1</link><pubDate>Tue, 31 Mar 2026 07:00:00 GMT</pubDate></item>"
        "<item><title>C</title><link>http://x/2</link><pubDate>Wed, 01 Apr 2026 07:00 GMT</pubDate></item>"
        "<item><title>E</title><link>http://x/3</link><pubDate>soon</pubDate></item>"
        "</channel></rss>"
    )
    assert sorted(rows(landing.read_feed(spark, str(tmp_path)))) == [
        ("A & B", "http://x/1", datetime(2026, 3, 31, 7), False), ("C", "http://x/2", datetime(2026, 4, 1, 7), False),
        ("E", "http://x/3", None, True),
    ]


def test_streamed_cleaning_takes_each_file_once(spark, news_folder, tmp_path):
    target, checkpoint = str(tmp_path / "clean"), str(tmp_path / "state")

    def run():
        query = clean_landed(spark, news_folder + "/*.csv", target, checkpoint, files_per_batch=1)
        query.awaitTermination(120)
        return sorted(rows(spark.read.parquet(target), "url", "crawl_date"))

    first = run()
    assert [u for u, _ in first] == ["u1", "u4", "u6"]
    assert run() == first
    (tmp_path / "CC_260403.csv").write_text(HEADER + "CC,Late,2026-04-03 10:00:00,text,u7\n")
    assert [u for u, _ in run()] == ["u1", "u4", "u6", "u7"]
