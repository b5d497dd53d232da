import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import rows
from tickerloom.operators import chunks as ch, scoring as sc

# tasks cannot import a test module: send its functions along
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_one_bad_row_costs_no_other_row(spark):
    asked = spark.sparkContext.accumulator(0)

    def make():
        def score(texts):
            asked.add(len(texts))
            if "t70" in texts:
                raise ValueError("refused")
            return [t.upper() for t in texts]

        return score

    df = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("p")).coalesce(1)
    found = {i: (r, e) for i, r, e in rows(sc.score_rows(df, F.col("p"), make), "id", "reply", "error")}
    assert found.pop(70) == (None, "ValueError: refused")
    assert found == {i: (f"T{i}", None) for i in range(100) if i != 70}
    assert asked.value == 100 + 32  # only the texts of the failed call were asked again


def test_a_scorer_is_made_once_per_task(spark):
    made = spark.sparkContext.accumulator(0)

    def make():
        made.add(1)
        return lambda texts: ["ok"] * len(texts)

    df = spark.range(5000).select(F.col("id").cast("string").alias("p"))
    assert sc.score_rows(df, F.col("p"), make, tasks=3).where("reply = 'ok'").count() == 5000
    assert made.value == 3


def test_too_few_replies_are_not_shifted(spark):
    def make():
        return lambda texts: ["r" + t for t in texts if t != "2"]

    df = spark.range(4).select(F.col("id").cast("string").alias("p")).coalesce(1)
    found = {p: (r, e is not None) for p, r, e in rows(sc.score_rows(df, F.col("p"), make), "p", "reply", "error")}
    assert found == {"0": ("r0", False), "1": ("r1", False), "2": (None, True), "3": ("r3", False)}


def test_classify_falls_back(spark):
    def make():
        return lambda texts: ["**Risk**" if t == "a" else "who knows" for t in texts]

    df = spark.createDataFrame([("a",), ("b",)], "p string")
    assert sorted(rows(sc.classify(df, F.col("p"), make), "p", "sentiment")) == [("a", "Risk"), ("b", "Neutral")]


def test_cue_scorer():
    score = sc.cue_scorer({"Growth": ["Expand"], "Risk": ["risk", "fear"]})()
    assert score(["it EXPANDS at risk", "no fear", "calm"]) == ["Growth", "Risk", "Neutral"]


def test_calls_batches_and_replies_are_bounded(spark):
    large, workers = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    size = 1 << 18

    def make():
        import resource

        peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
        before = peak()

        def score(texts):
            if len(texts) > 1 and sum(map(len, texts)) > 1 << 20:
                large.add(1)
            if any(t.startswith("399") for t in texts):
                workers.add(peak() - before)
            return [t + "!" for t in texts]

        return score

    df = spark.range(400).coalesce(1).select("id", F.concat("id", F.repeat(F.lit("x"), F.lit(size))).alias("p"))
    scored = sc.score_rows(df, F.col("p"), make)
    assert scored.where("reply = concat(p, '!') AND error IS NULL").count() == 400
    # 400 texts are 100 MB
    assert large.value == 0 and workers.value < 100


def test_translations_of_long_chunks_come_back_in_bounded_calls(spark):
    large = spark.sparkContext.accumulator(0)

    def make():
        def score(texts):
            if len(texts) > 1 and sum(map(len, texts)) > 1 << 20:
                large.add(1)
            return [f'[{{"id": {t[:3]}, "title": "t", "content": "{t}"}}]' for t in texts]

        return score

    chunks = spark.range(100, 140).coalesce(1).select(
        F.lit("T").alias("ticker"), F.col("id").alias("chunk"), F.concat("id", F.repeat(F.lit("x"), F.lit(1 << 18))).alias("prompt"),
        F.array(F.struct((F.col("id") + 1).alias("row_id"), F.lit("d").alias("date"), F.lit("u").alias("url"))).alias("rows"),
    )
    replied = sc.score_rows(chunks, F.col("prompt"), make)
    zipped = rows(ch.zip_replies(replied), "id", F.length("content"))
    assert sorted(zipped) == [(i + 1, 3 + (1 << 18)) for i in range(100, 140)]
    assert large.value == 0
