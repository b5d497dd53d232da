from pyspark.sql import functions as F

from conftest import rows
from tickerloom.constants import COMPANY_NAMES, SECTOR_SYMBOLS
from tickerloom.operators import fundamentals as fd, lookups as lk, news as nw


def symbols(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def test_look_up_defaults(spark):
    pairs = [(s, sector) for sector, members in SECTOR_SYMBOLS.items() for s in members]
    sectors = spark.createDataFrame(pairs, "symbol string, sector string")
    companies = spark.createDataFrame(list(COMPANY_NAMES.items()), "symbol string, company string")
    found = lk.look_up(symbols(spark, "NVDA", "ZZ"), sectors, "symbol", "sector", F.lit(""))
    found = lk.look_up(found, companies, "symbol", "company", F.col("symbol"))
    assert sorted(rows(found, "symbol", "sector", "company")) == [("NVDA", "테크·AI", "Nvidia"), ("ZZ", "", "ZZ")]


def test_badges(spark):
    results = spark.createDataFrame([("A", "x"), ("A", "y"), ("A", "x"), ("B", "x"), ("C", "y"), ("D", "z")], "symbol string, model string")
    found = lk.availability(symbols(spark, "A", "B", "C", "D", "E"), results, "symbol", "model", "x", "y")
    assert dict(rows(found)) == {"A": "x · y", "B": "x", "C": "y", "D": "", "E": ""}


def test_to_do_and_done(spark):
    done = symbols(spark, "B", "B", "X")
    assert rows(lk.to_do(symbols(spark, "A", "B"), done, "symbol")) == [("A",)]
    assert rows(lk.already_done(symbols(spark, "A", "B"), done, "symbol")) == [("B",)]


def test_missing_inputs(spark):
    news = spark.createDataFrame([("A", True), ("A", False), ("B", False), ("B", None)], "symbol string, ok boolean")
    found = lk.missing_inputs(symbols(spark, "A", "B", "C"), news, "symbol", F.col("ok"))
    assert dict(rows(found)) == {"B": "no valid rows", "C": "no input"}


def test_shared_values(spark):
    rates = spark.createDataFrame([(1.5,), (2.5,)], "r double").agg(F.max("r"))
    found = lk.with_shared(symbols(spark, "A", "B"), top=rates)
    assert sorted(rows(found)) == [("A", 2.5), ("B", 2.5)]


def test_empty_choice_keeps_nothing(spark):
    news = spark.createDataFrame([("Risk",)], "sentiment string")
    assert nw.with_labels(news, "sentiment", []).count() == 0
    assert nw.with_labels(news, "sentiment", ["Risk"]).count() == 1


def test_union_of_differing_columns(spark):
    raw = spark.createDataFrame([("t", "u")], "title string, url string")
    translated = spark.createDataFrame([(1, "t2", "u2")], "id bigint, title string, url string")
    assert sorted(rows(nw.union_sources(raw, translated), "title", "id")) == [("t", None), ("t2", 1)]


def test_grade_shares_without_grades(spark):
    tally = spark.createDataFrame([("A", 0, 0), ("B", None, 3), ("C", 1, 7)], "symbol string, buy bigint, hold bigint")
    found = sorted(rows(fd.grade_shares(tally, "symbol", ["buy", "hold"]), "symbol", "grade", "pct"))
    # an exact half goes to the even side: 12.5 -> 12, 87.5 -> 88
    assert found == [("A", "buy", 0), ("A", "hold", 0), ("B", "buy", 0), ("B", "hold", 100), ("C", "buy", 12), ("C", "hold", 88)]


def test_grade_changes_show_only_present_columns(spark):
    grades = spark.sql("SELECT DATE'2026-04-01' AS date, 'Buy' AS newGrade, 'Reiterated' AS action, 1 AS other")
    view = fd.grade_changes(grades)
    assert view.columns == ["날짜", "현재 등급", "변경"]
    assert rows(view) == [("2026-04-01", "Buy", "⚪ 유지")]


def test_slim_passes_undeclared_text(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), (None,)], "t string")
    assert rows(df, fd.slim(F.col("t"), {"a": "bigint", "z": "string"})["a"], fd.slim(F.col("t"), None)) == [
        (1, '{"a": 1, "b": 2}'), (None, None),
    ]


def test_trailing_total_needs_all_periods(spark):
    df = spark.createDataFrame([("A", q, float(q)) for q in range(1, 6)] + [("B", 1, 1.0)], "s string, q int, v double")
    assert sorted(rows(fd.trailing_total(df, "s", "q", "v"), "s", "q", "ttm")) == [("A", 4, 10.0), ("A", 5, 14.0)]
    # a missing period is a gap: no total over it, no growth across it
    gap = spark.createDataFrame([("A", q, float(q)) for q in (1, 2, 4, 5, 6, 7)], "s string, q int, v double")
    assert rows(fd.trailing_total(gap, "s", "q", "v"), "s", "q", "ttm") == [("A", 7, 22.0)]
    assert dict(rows(fd.growth(gap, "s", "q", "v"), "q", "previous"))[4] is None
    growth = sorted(rows(fd.growth(df, "s", "q", "v"), "s", "q", "growth_pct"))
    assert growth[:2] == [("A", 1, None), ("A", 2, 100.0)]
