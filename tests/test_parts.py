"""Documents in parts and digests by levels: small symbols as before, large ones without a row of their own size."""

import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import rows
from tickerloom.operators import news as nw
from tickerloom.plans import daily, documents as dc, parts as pt

# tasks cannot import a test module: send its functions along
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEWS = "symbol string, id int, date timestamp_ntz, title string, url string, sentiment string"
START = datetime(2026, 4, 1, 8)


@pytest.fixture
def labelled(many_tasks):
    news = [("HOT", i, START + timedelta(minutes=i), f"t{i}", f"u{i}", "Growth") for i in range(900)]
    news += [(s, 9000 + i, START + timedelta(hours=7 * i), "small", "u", "Risk") for s in ("AA", "BB") for i in range(5)]
    return many_tasks.createDataFrame(news, NEWS).repartition(4)


def _condense():
    return lambda texts: [f"<{sum(line.startswith('  [') for line in t.split(chr(10)))}+{t.count('<')}>" for t in texts]


def _judge():
    return lambda texts: ["[투자 판단]\n보류" for _ in texts]


def test_small_documents_are_equal_and_parts_are_bounded(many_tasks, labelled, tmp_path):
    placed = dc.place_articles(labelled, 50)
    counts = nw.daily_counts(labelled)
    contexts = dc.symbol_contexts(placed, counts, many_tasks.createDataFrame([], "symbol string, analyst_block string"))
    plain = dc.analysis_documents(placed, counts, contexts, "m", "2026-04-02T00:00:00")
    path = str(tmp_path / "parts")
    pt.write_parts(pt.document_parts(placed, counts, contexts, "m", "2026-04-02T00:00:00"), path)
    parts = many_tasks.read.parquet(path)
    assert sorted(str(r.asDict(True)) for r in pt.whole_documents(parts).collect()) == sorted(str(r.asDict(True)) for r in plain.collect())
    assert parts.agg(F.max(F.size("articles"))).first()[0] == 50
    assert sorted(rows(parts.where("symbol = 'HOT'"), "part")) == [(i,) for i in range(19)]


def test_tree_of_digests(many_tasks, labelled):
    placed = dc.place_articles(labelled, 20)
    whole = dict(rows(dc.news_blocks(placed)))
    found = {s: (text, lost) for s, text, lost in rows(pt.digest_tree(placed, _condense, most=500, fan_in=4), "symbol", "news_block", "lost")}
    assert {s: found[s] for s in ("AA", "BB")} == {s: (whole[s], 0) for s in ("AA", "BB")}
    # 45 pieces of 20 lines, in groups of four: twelve texts of a level that fits
    assert found["HOT"] == ("\n".join(["<80+0>"] * 11 + ["<20+0>"]), 0)
    deeper = dict(rows(pt.digest_tree(placed, _condense, most=20, fan_in=4), "symbol", "news_block"))
    assert deeper["HOT"] == "<0+4>\n<0+4>\n<0+4>"
    assert dict(rows(pt.digest_tree(placed, _condense, most=10**6), "symbol", "news_block")) == whole


def _refuses():
    def score(texts):
        if any("] t5\n" in t for t in texts):
            raise ValueError("no")
        return ["ok" for _ in texts]

    return score


def test_lost_groups_are_counted(labelled):
    placed = dc.place_articles(labelled, 20)
    found = {s: (text, lost) for s, text, lost in rows(pt.digest_tree(placed, _refuses, most=500, fan_in=4), "symbol", "news_block", "lost")}
    assert found["HOT"][1] == 1 and found["HOT"][0].count("ok") == 11
    with pytest.raises(ValueError):
        pt.digest_tree(placed, _refuses, fan_in=1)


def test_a_day_run_in_parts(many_tasks, labelled):
    nothing = many_tasks.createDataFrame([], "symbol string")
    parts = daily.build_parts(labelled, nothing, _judge, _condense, "m", most=3000, piece_rows=50)
    heads = {r.symbol: r.header for r in parts.where("part = 0").collect()}
    assert set(heads) == {"HOT", "AA", "BB"}
    assert len(heads["HOT"].analyst_context.news_block) <= 3000 < 900 * len("  [Growth] t")
    assert heads["HOT"].meta.news_count == 900 and heads["HOT"].investment_judgment.endswith("보류")
    assert parts.where("symbol = 'HOT'").agg(F.sum(F.size("articles"))).first()[0] == 900
