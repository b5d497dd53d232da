"""Blocks and documents against plain Python over a few hundred rows."""

import random
import sys
from datetime import date, datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import rows
from tickerloom.constants import LABELS
from tickerloom.operators import chunks as ch, labels as lb, news as nw
from tickerloom.plans import daily, documents as dc
from tickerloom.sources import landing, sinks

# tasks cannot import a test module: send its functions along
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEWS = "symbol string, id int, date timestamp_ntz, title string, url string, sentiment string"


def make_news(n=400, seed=3):
    rng = random.Random(seed)
    start = datetime(2026, 3, 29)
    found = []
    for i in range(n):
        symbol = "HOT" if rng.random() < 0.7 else rng.choice(["AA", "BB"])
        at = start + timedelta(minutes=rng.randrange(0, 6 * 24 * 60, 97))  # many equal times
        found.append((symbol, i, at, f"title {i} [x]\\", f"u{i}", rng.choice(LABELS[:4])))
    found.append(("ONE", n, start, "only", "u", "Risk"))
    return found


def recent_of(news):
    last = {}
    for symbol, _, at, *_ in news:
        last[symbol] = max(last.get(symbol, at), at)
    return [r for r in news if r[2].date() >= last[r[0]].date() - timedelta(days=2)]


def digest_of(members):
    """Expected digest: a piece of text per day, put together in day order."""
    by_day = {}
    for r in sorted(members, key=lambda r: (-r[2].timestamp(), r[1])):
        by_day.setdefault(str(r[2].date()), []).append("\n  [%s] %s" % (r[5], r[3]))
    return "\n".join("\n── " + day + " ──" + "".join(by_day[day]) for day in sorted(by_day))


@pytest.mark.parametrize("piece_rows", [7, 1000])
def test_pieces_join_to_the_whole_block(many_tasks, piece_rows):
    news = make_news()
    df = many_tasks.createDataFrame(news, NEWS).repartition(5)
    placed = dc.place_articles(nw.recent_window(df), piece_rows)
    blocks = dict(rows(dc.news_blocks(placed)))
    lists = dict(rows(dc.article_lists(placed)))
    recent = recent_of(news)
    for symbol in {r[0] for r in news}:
        members = [r for r in recent if r[0] == symbol]
        assert blocks[symbol] == digest_of(members)
        newest = sorted(members, key=lambda r: (-r[2].timestamp(), r[1]))
        assert [(a.date, a.title, a.url, a.sentiment) for a in lists[symbol]] == [
            (f"{r[2]:%Y-%m-%d %H:%M:%S}", r[3], r[4], r[5]) for r in newest
        ]


def test_sentiment_block(spark):
    day = lambda d: datetime(2026, 4, d, 8)
    labels = [(1, "Growth"), (1, "Growth"), (2, "Risk"), (2, "Growth"), (2, "Mixed")] + [(3, "Neutral")] * 11
    # within a day the later entries are the newer articles
    news = [("A", i, day(d) + timedelta(minutes=i), "t", "u", label) for i, (d, label) in enumerate(labels)]
    news += [("B", 99, day(3), "t", "u", "Negative"), ("B", 98, datetime(2026, 3, 1), "t", "u", "Mixed")]
    df = spark.createDataFrame(news, NEWS)
    found = dict(rows(dc.sentiment_blocks(nw.daily_counts(nw.recent_window(df)))))
    assert found["A"].split("\n") == [
        "총 뉴스 16건 분석 결과:",
        "  Positive     0건 (  0.0%) ",
        "  Growth       3건 ( 18.8%) ███",
        "  Neutral     11건 ( 68.8%) █████████████",
        "  Mixed        1건 (  6.2%) █",
        "  Risk         1건 (  6.2%) █",
        "  Negative     0건 (  0.0%) ",
        "",
        "날짜별 감정 흐름:",
        "  2026-04-01: Growth:2",
        "  2026-04-02: Mixed:1, Growth:1, Risk:1",
        "  2026-04-03: Neutral:11",
    ]
    assert found["B"].startswith("총 뉴스 1건") and found["B"].endswith("  2026-04-03: Negative:1")
    assert found == dict(rows(dc.sentiment_blocks(nw.recent_days(nw.daily_counts(df)))))


def test_recent_window_edges(spark):
    at = lambda *a: datetime(2026, 4, *a)
    news = [
        ("A", 1, at(3, 23), "t", "u", "Risk"), ("A", 2, at(1), "t", "u", "Risk"),
        ("A", 3, at(1) - timedelta(microseconds=1), "t", "u", "Risk"), ("B", 4, datetime(2020, 1, 1), "t", "u", "Risk"),
    ]
    df = spark.createDataFrame(news, NEWS)
    once = nw.recent_window(df)
    assert sorted(i for (i,) in rows(once, "id")) == [1, 2, 4]
    assert sorted(i for (i,) in rows(nw.recent_window(once), "id")) == [1, 2, 4]
    kept = nw.window_retention(nw.daily_counts(df))
    assert sorted(rows(kept, "symbol", "n_all", "n_recent")) == [("A", 3, 2), ("B", 1, 1)]


def test_shares(spark):
    days = [("A", date(2026, 3, 31), "Growth", 1), ("A", date(2026, 4, 1), "Risk", 15), ("A", date(2026, 4, 1), None, 0)]
    counts = spark.createDataFrame(days, "symbol string, day date, label string, n bigint").withColumn(
        "newest", F.col("day").cast("timestamp_ntz")
    )
    shares = {label: pct for _, label, _, _, pct in rows(lb.label_shares(counts))}
    assert shares == {"Growth": 6.2, "Risk": 93.8, "Positive": 0, "Neutral": 0, "Mixed": 0, "Negative": 0}
    assert abs(sum(shares.values()) - 100) <= 0.3
    assert rows(lb.news_period(counts), "news_count", "news_period") == [(16, "2026-03-31 ~ 2026-04-01")]
    assert lb.label_map(counts).first()["sentiment_summary"] == {"Risk": 15, "Growth": 1}
    by_day = lb.day_label_map(counts).select(F.to_json("sentiment_by_date")).first()[0]
    assert by_day == '{"2026-03-31":{"Growth":1},"2026-04-01":{"Risk":15}}'
    pivot = rows(lb.day_pivot(counts).orderBy("day"), "Growth", "Risk", "Mixed")
    assert pivot == [(1, None, None), (None, 15, None)]


def test_template_keeps_braces_in_text(spark):
    df = spark.createDataFrame([("{labels}", "L{news}", "A")], "news_block string, sentiment_block string, analyst_block string")
    assert df.select(dc.fill_template("<{news}|{labels}|{analysts}> {other}")).first()[0] == "<{labels}|L{news}|A> {other}"


def _labeller():
    def score(texts):
        if any("BOOM" in t for t in texts):
            raise ValueError("no answer")
        return ["**Growth**" if "up" in t else "risk" for t in texts]

    return score


def _judge():
    def score(texts):
        return ["[핵심 요약]\nx\n[투자 판단]\n투자" for _ in texts]

    return score


def test_day_run(spark):
    landed = [
        ("AA", "goes up", "2026-04-02 10:00:00", "body", "u1"), ("AA", "down", "2026-04-01 10:00:00", None, "u2"),
        ("AA", "BOOM", "2026-04-01 09:00:00", "x", "u3"), ("AA", "old up", "2026-03-01 09:00:00", "x", "u4"),
        ("AA", "url", "2026-04-09 09:00:00", "x", "u5"), ("BB", "noise", "2026-04-02 10:00:00", "Access denied", "u6"),
        ("BB", "up", "2026-04-02 10:00:00", "y", "u7"), ("CC", "x", "never", "y", "u8"),
    ]
    news = spark.createDataFrame(landed, "symbol string, title string, date string, content string, url string")
    news = news.withColumn("id", F.substring("url", 2, 9).cast("int"))
    labelled = daily.label_news(news, _labeller, tasks=2)
    assert sorted(rows(labelled, "url", "sentiment")) == [("u1", "Growth"), ("u2", "Risk"), ("u3", "Neutral"), ("u7", "Growth")]
    assert rows(labelled.where("error is not null"), "url", "error") == [("u3", "ValueError: no answer")]

    fundamentals = spark.createDataFrame([("AA", 5)], "symbol string, buy bigint").select("symbol", F.struct(
        F.struct(F.lit("d").alias("description"), F.array(F.struct("buy")).alias("data")).alias("grades_consensus")
    ).alias("analyst"))
    docs = {d.symbol: d for d in daily.build_documents(labelled, fundamentals, _judge, "m").collect()}
    assert set(docs) == {"AA", "BB"}
    assert docs["AA"].meta.news_count == 3 and docs["AA"].meta.news_period == "2026-04-01 ~ 2026-04-02"
    assert docs["AA"].sentiment_summary == {"Growth": 1, "Neutral": 1, "Risk": 1}
    assert [a.url for a in docs["AA"].news_with_sentiment] == ["u1", "u2", "u3"]
    assert docs["AA"].analyst_context.analyst_block.endswith("Strong Buy: 0  Buy: 5  Hold: 0  Sell: 0  Strong Sell: 0")
    assert docs["BB"].analyst_context.analyst_block == ""
    assert docs["BB"].investment_judgment.endswith("투자")


def test_one_document_and_judgment_at_any_size(many_tasks, tmp_path):
    """2,500 recent articles of one symbol: one document, written and read back whole."""
    start = datetime(2026, 4, 1, 8)
    news = [("HOT", i, start + timedelta(minutes=i), f"t{i}", f"u{i}", "Growth") for i in range(2500)]
    news += [("ONE", 9000, start, "t", "u", "Risk")]
    labelled = nw.recent_window(many_tasks.createDataFrame(news, NEWS).repartition(5))
    nothing = many_tasks.createDataFrame([], "symbol string")
    target = str(tmp_path / "docs")
    for model in ("m.1", "m2"):
        sinks.write_documents(daily.build_documents(labelled, nothing, _judge, model), target)
    back = landing.read_documents(many_tasks, target)
    assert sorted(rows(back, "symbol", "model")) == [("HOT", "m.1"), ("HOT", "m2"), ("ONE", "m.1"), ("ONE", "m2")]
    hot = landing.read_documents(many_tasks, target, "HOT", "m2").first()
    assert hot.meta.news_count == 2500
    assert [a.url for a in hot.news_with_sentiment] == [f"u{i}" for i in reversed(range(2500))]
    assert hot.analyst_context.news_block == digest_of([r for r in news if r[0] == "HOT"])
    assert hot.investment_judgment
    done = back.where("model = 'm2'").select("symbol")
    assert daily.build_documents(labelled, nothing, None, "m2", done=done).count() == 0


def test_skipped_symbols_have_a_reason(spark):
    symbols = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "symbol string")
    news = spark.createDataFrame([("A", "t", "2026-04-01"), ("B", "t", "never"), ("D", "t", "2026-04-01")], "symbol string, title string, date string")
    done = spark.createDataFrame([("A",), ("A",)], "symbol string")
    assert sorted(rows(daily.skipped(symbols, news, done))) == [("A", "done"), ("B", "no valid rows"), ("C", "no input")]


def test_dropped_rows_are_counted(spark):
    news = spark.createDataFrame(
        [("A", " url ", "2026-04-01"), ("A", "t", "never"), ("A", "t", "2026-04-01"), ("A", None, None)], "symbol string, title string, date string"
    )
    assert rows(nw.dropped_rows(news)) == [("A", 4, 2, 1)]


def test_prompts_of_repeated_and_missing_ids(spark):
    """One story under two tickers, a null id and a null title: every row is in one prompt, once."""
    news = spark.createDataFrame(
        [("NVDA", "u1", "d", "T", "c", "u1"), ("MSFT", "u1", "d", "T", "c", "u1"), ("NVDA", None, None, "N", None, "u2"), ("NVDA", "u3", "d", None, "x", "u3"), ("NVDA", "u3", "d", "again", "x", "u3")],
        "ticker string, id string, date string, title string, content string, url string",
    )
    found = {r.ticker: r for r in ch.chunk_prompts(news).collect()}
    assert [x.url for x in found["MSFT"].rows] == ["u1"]
    assert sorted(x.url for x in found["NVDA"].rows) == ["u1", "u2", "u3", "u3"]
    lines = found["NVDA"].prompt.split("\n")
    assert len(lines) == 4 and [x.split("]")[0] for x in lines] == [f"[ID:{i}" for i in range(4)]
    assert any("제목:  | 본문: x" in x for x in lines)


def _translator():
    import json
    import re

    def score(prompts):
        out = []
        for p in prompts:
            if "BOOM" in p:
                raise ValueError("no answer")
            ids = [int(i) for i in re.findall(r"^\[ID:(\d+)\]", p, re.M)]
            out.append(json.dumps([{"id": i, "title": f"T{i}", "content": "c"} for i in ids if i != 1]))
        return out

    return score


@pytest.mark.parametrize("n", [0, 1, 5, 6, 11])
def test_translation(spark, n):
    news = [(i * 10, "AA", "d", "BOOM" if i == 7 else f"t{i}", "body", f"u{i}") for i in range(n)]
    df = spark.createDataFrame(news, "id bigint, ticker string, date string, title string, content string, url string")
    translated, open_rows = daily.translate_news(df, _translator)
    lost = {1} | (set(range(5, 10)) if n > 7 else set())  # a failed chunk gives no rows
    assert sorted(rows(translated, "id", "title", "url")) == [(i + 1, f"T{i}", f"u{i}") for i in range(n) if i not in lost]
    assert sorted(i for (i,) in rows(open_rows, "row_id")) == [i + 1 for i in range(n) if i in lost]


def test_article_analysis(spark):
    def make():
        def score(texts):
            if any("BOOM" in t for t in texts):
                raise TimeoutError("late")
            return ['```json\n{"sentiment": "긍정", "score": 0.5, "keywords": ["k"]}\n```' if "ok" in t else "hm" for t in texts]

        return score

    news = spark.createDataFrame([("a", "ok Privacy Policy tail"), ("b", "BOOM"), ("c", "?")], "title string, content string")
    found = daily.analyse_news(news, make, F.col("content_cleaned"))
    assert sorted(rows(found, "title", "content_cleaned", "sentiment", "score", "keywords")) == [
        ("a", "ok", "긍정", 0.5, "k"), ("b", "BOOM", "오류", 0.0, ""), ("c", "?", "분석실패", 0.0, ""),
    ]
