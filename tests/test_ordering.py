"""Row numbers, neighbours and medians with one key holding most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tickerloom.operators import ordering as od


@pytest.fixture
def skewed(many_tasks):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(2000)]
    data.append(("one", 3, 5000))
    return data, many_tasks.createDataFrame(data, "k string, v int, id int").repartition(7)


def grouped(data):
    groups = {}
    for k, v, i in data:
        groups.setdefault(k, []).append((v, i))
    return groups


def test_number_rows_spans_tasks(skewed):
    data, df = skewed
    table = od.lay_out(df, ["k"], [F.col("v").desc(), F.col("id")])
    spread = dict(rows(table.groupBy("k").agg(F.countDistinct(od.SEGMENT)).where("k = 'hot'")))
    assert spread["hot"] > 1  # the hot key really is in several tasks
    numbered = od.number_rows(df, ["k"], [F.col("v").desc(), F.col("id")], "n", "total")
    expected = {
        (k, i): (n, len(group))
        for k, group in grouped(data).items()
        for n, (_, i) in enumerate(sorted(group, key=lambda r: (-r[0], r[1])), 1)
    }
    assert {(k, i): (n, t) for k, i, n, t in rows(numbered, "k", "id", "n", "total")} == expected


def test_number_rows_without_broadcast(skewed, many_tasks):
    data, df = skewed
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    many_tasks.conf.set(key, "-1")
    numbered = od.number_rows(df, ["k"], [F.col("id")], "n")
    counted = {}
    for k, n in rows(numbered, "k", "n"):
        counted.setdefault(k, []).append(n)
    many_tasks.conf.unset(key)
    assert all(sorted(ns) == list(range(1, len(ns) + 1)) for ns in counted.values())
    assert sum(map(len, counted.values())) == len(data)


def test_previous_value(skewed):
    data, df = skewed
    expected = {}
    for k, group in grouped(data).items():
        before = None
        for v, i in sorted(group, key=lambda r: r[1]):
            expected[(k, i)] = before
            before = v
    found = od.previous_value(df, ["k"], [F.col("id")], "v", "before")
    assert {(k, i): b for k, i, b in rows(found, "k", "id", "before")} == expected


def test_previous_value_may_be_null(many_tasks):
    df = many_tasks.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("a", 4, "y")], "k string, id int, v string")
    found = od.previous_value(df, ["k"], [F.col("id")], "v", "before")
    assert sorted(rows(found, "id", "before"), key=lambda r: r[0]) == [(1, None), (2, None), (3, "x"), (4, None)]


def test_exact_median(skewed):
    data, df = skewed
    expected = {k: statistics.median(v for v, _ in group) for k, group in grouped(data).items()}
    assert dict(rows(od.exact_median(df, ["k"], "v", "id", "m"))) == expected


def test_latest_rows_limits_before_the_shuffle(skewed):
    _, df = skewed
    latest = od.latest_rows(df, ["k"], [F.col("id").desc()], 3)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(n for k, n in rows(latest, "k", "rec_no") if k == "hot") == [1, 2, 3]
