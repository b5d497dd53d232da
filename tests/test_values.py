import math
import random
from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from tickerloom.functions import values as v


def test_fixed_rounds_as_python_does(spark):
    rng = random.Random(1)
    numbers = [0.35, 12.35, 12.25, 6.25, 0.25, 2.5, 3.5, 0.05, -0.04, 1234567.25, 2.675, 99.95] + [
        round(rng.uniform(0, 100), rng.randrange(1, 6)) for _ in range(300)
    ] + [c / t * 100 for t in (16, 80, 2000) for c in range(1, 16)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for digits in (0, 1, 2):
        found = rows(df, "x", v.fixed(F.col("x"), digits))
        assert [t for _, t in found] == [f"{x:.{digits}f}" for x, _ in found]
    found = rows(df, "x", v.rounded(F.col("x"), 1))
    assert [r for _, r in found] == [round(x, 1) for x, _ in found]


def test_number_text(spark):
    numbers = [299.0, 256.15, 163.59675411271115, 0.001, 1e7, 12345678.9, 2.5e15, 0.00025, -3.0, 0.0, 1.5e-4]
    expected = ["299", "256.15", "163.59675411271115", "0.001", "10000000", "12345678.9", "2500000000000000", "0.00025", "-3", "0", "0.00015"]
    df = spark.createDataFrame(list(zip(range(len(numbers)), numbers)), "i int, x double").orderBy("i")
    assert [t for (t,) in rows(df, v.number_text(F.col("x")))] == expected


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([("7",), ("1234",)], "t string")
    assert rows(df, v.pad_left(F.col("t"), 3), v.pad_right(F.col("t"), 3)) == [("  7", "7  "), ("1234", "1234")]


def test_percent_bar_and_share(spark):
    df = spark.createDataFrame([(1, 16), (0, 0), (5, 5)], "n bigint, t bigint")
    share = v.rounded(v.share_percent(F.col("n"), F.col("t")), 1)
    assert rows(df, share, v.percent_bar(share)) == [(6.2, "█"), (0.0, ""), (100.0, "█" * 20)]


def test_first_nonblank_and_filled(spark):
    df = spark.createDataFrame([(None, "  ", " x "), ("", None, None), ("a ", "b", None)], "a string, b string, c string")
    columns = [F.col("a"), F.col("b"), F.col("c")]
    assert [t for (t,) in rows(df, v.first_nonblank(columns))] == ["x", None, "a"]
    assert [t for (t,) in rows(df, v.first_filled(columns, "none"))] == ["  ", "none", "a "]


def test_lenient_timestamp(spark):
    df = spark.createDataFrame([("2024-01-31 10:30:00",), ("2024-02-30",), ("soon",), (None,), ("2024-03-01",)], "t string")
    assert [t for (t,) in rows(df, v.lenient_timestamp(F.col("t")))] == [
        datetime(2024, 1, 31, 10, 30), None, None, None, datetime(2024, 3, 1),
    ]


def test_feed_timestamp_drops_the_zone(spark):
    texts = ["Tue, 31 Mar 2026 07:05:09 GMT", "Wed, 1 Apr 2026 23:59:59 +0900", "x", "Sun, 30 Feb 2026 07:00:00 GMT", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [t for (t,) in rows(df, v.feed_timestamp(F.col("t")))] == [
        datetime(2026, 3, 31, 7, 5, 9), datetime(2026, 4, 1, 23, 59, 59), None, None, None,
    ]


def test_dates_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    moment = datetime(2024, 3, 10, 2, 30, 5, 120000)  # skipped by New York's clocks
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(moment, "Sun, 10 Mar 2024 02:30:05 GMT")], "t timestamp_ntz, f string")
        t = F.col("t")
        assert rows(df, v.clock_text(t), v.day_text(t), v.dotted_text(t), v.stamp_text(t), v.month_text(v.day_text(t))) == [
            ("2024-03-10 02:30:05", "2024-03-10", "2024.03.10  02:30", "240310", "2024-03")
        ]
        assert rows(df, v.feed_timestamp(F.col("f"))) == [(datetime(2024, 3, 10, 2, 30, 5),)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_publish_window_includes_both_bounds(spark):
    as_of = datetime(2026, 4, 2, 9, 30, 15)
    first, last = v.publish_bounds(as_of)
    assert (first, last) == (datetime(2026, 3, 30, 0, 0, 15), datetime(2026, 4, 1, 23, 59, 15))
    moments = [first, last, datetime(2026, 3, 30, 0, 0, 14, 999999), datetime(2026, 4, 1, 23, 59, 15, 1)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    assert [t for (t,) in rows(df.where(v.in_publish_window(F.col("t"), as_of)))] == [first, last]


def test_display_keeps_unknown_codes(spark):
    df = spark.createDataFrame([("UPGRADE",), ("hold",), (None,)], "a string")
    assert [t for (t,) in rows(df, v.display(F.col("a"), {"upgrade": "up"}, lower=True))] == ["up", "hold", None]


def test_exact_sum_ignores_order(spark):
    values = [0.1, 0.2, 0.3, 1e9, -1e9] * 200
    forward = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
    backward = spark.createDataFrame([(x,) for x in reversed(values)], "x double").repartition(5)
    sums = {rows(df.agg(v.exact_sum(F.col("x")), v.exact_mean(F.col("x"))))[0] for df in (forward, backward)}
    assert len(sums) == 1 and math.isclose(sums.pop()[0], 120.0, abs_tol=1e-9)


def test_rounded_keeps_what_is_not_finite(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (None,), (1e20,)], "x double")
    found = [r for (r,) in rows(df, v.rounded(F.col("x"), 1))]
    assert found[:2] == [math.inf, -math.inf] and math.isnan(found[2]) and found[3:] == [None, 1e20]


def test_exact_mean_skips_what_is_not_a_number(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,), (2.0,)], "x double")
    assert rows(df.agg(v.exact_mean(F.col("x")), v.exact_sum(F.col("x")))) == [(1.5, 3.0)]
