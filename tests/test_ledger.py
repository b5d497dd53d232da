"""The answer ledger: equal prompts asked once, answered ones never again."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import rows
from tickerloom.operators import scoring as sc
from tickerloom.operators.ledger import Ledger
from tickerloom.plans import daily

# tasks cannot import a test module: send its functions along
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counting(counter, refuse=()):
    def make():
        def score(texts):
            if any(t in refuse for t in texts):
                raise ValueError("refused")
            counter.add(len(texts))
            return [f"{t}!" for t in texts]

        return score

    return make


def prompts(spark, n, copies=2):
    return spark.range(n * copies).select("id", F.concat(F.lit("p"), (F.col("id") % n).cast("string")).alias("p"))


def test_equal_prompts_are_asked_once(spark, tmp_path):
    asked, ledger = spark.sparkContext.accumulator(0), Ledger(str(tmp_path / "l"), "m")
    for _ in range(2):
        found = sc.score_rows(prompts(spark, 50), F.col("p"), counting(asked), ledger=ledger)
        assert sorted(rows(found, "id", "reply", "error")) == [(i, f"p{i % 50}!", None) for i in range(100)]
    assert asked.value == 50
    other = Ledger(str(tmp_path / "l"), "another model")
    sc.score_rows(prompts(spark, 50), F.col("p"), counting(asked), ledger=other)
    assert asked.value == 100


def test_a_run_that_broke_off_goes_on(spark, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "l"), spark.sparkContext.accumulator(0)
    ledger = Ledger(path, "m", batch_rows=7)
    plain, written = Ledger._append, []

    def killed(self, answered):
        if len(written) == 3:
            raise KeyboardInterrupt
        written.append(1)
        plain(self, answered)

    monkeypatch.setattr(Ledger, "_append", killed)
    with pytest.raises(KeyboardInterrupt):
        sc.score_rows(prompts(spark, 60), F.col("p"), counting(asked), ledger=ledger)
    first = asked.value
    answered = ledger.answers(spark).count()
    assert 0 < answered < 60 and first - answered <= 20  # at most the batch that was lost
    monkeypatch.setattr(Ledger, "_append", plain)
    found = sc.score_rows(prompts(spark, 60), F.col("p"), counting(asked), ledger=ledger)
    assert asked.value == first + 60 - answered
    assert sorted(rows(found, "id", "reply")) == [(i, f"p{i % 60}!") for i in range(120)]


def test_failed_prompts_are_open_again(spark, tmp_path):
    asked, ledger = spark.sparkContext.accumulator(0), Ledger(str(tmp_path / "l"), "m")
    found = sc.score_rows(prompts(spark, 40, 1), F.col("p"), counting(asked, ["p3", "p9"]), ledger=ledger)
    assert {i: (r, e) for i, r, e in rows(found, "id", "reply", "error")}[3] == (None, "ValueError: refused")
    assert asked.value == 38
    found = sc.score_rows(prompts(spark, 40, 1), F.col("p"), counting(asked), ledger=ledger)
    assert asked.value == 40 and found.where("error IS NOT NULL").count() == 0


def test_null_prompts_and_no_prompts(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "l"), "m")

    def make():
        return lambda texts: [str(t) for t in texts]

    df = spark.createDataFrame([(1, None), (2, None), (3, "")], "id int, p string")
    assert sorted(rows(sc.score_rows(df, F.col("p"), make, ledger=ledger), "id", "reply")) == [(1, "None"), (2, "None"), (3, "")]
    assert sc.score_rows(df.limit(0), F.col("p"), make, ledger=Ledger(str(tmp_path / "none"), "m")).collect() == []


def test_one_story_under_two_tickers(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)
    news = spark.createDataFrame(
        [(t, f"{t}{i}", f"Story {i}", "2026-04-01 10:00:00", f"body {i}", "u") for t in "AB" for i in range(12)],
        "symbol string, id string, title string, date string, content string, url string",
    )
    ledger = Ledger(str(tmp_path / "l"), "m")
    labelled = daily.label_news(news, counting(asked), ledger=ledger)
    assert labelled.count() == 24 and asked.value == 12
    # the next day brings one more story
    more = news.union(spark.createDataFrame([("C", "C1", "New", "2026-04-01 10:00:00", "b", "u")], news.schema))
    assert daily.label_news(more, counting(asked), ledger=ledger).count() == 25
    assert asked.value == 13
