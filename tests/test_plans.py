"""Plans: what reaches the scan, what is broadcast, where Python runs."""

import pytest
from pyspark.sql import functions as F

from tickerloom.catalog import all_queries
from tickerloom.operators import lookups as lk

SF_DIR = "/root/testdata/sf0.001"
CALLS_A_MODEL = {"article_analysis", "cue_label", "positional_zip", "reply_id_join", "reply_unanswered", "symbol_judgment", "analysis_document"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(all_queries()))
def test_python_only_where_a_model_is_called(spark, key):
    text = plan(all_queries()[key](spark, SF_DIR))
    assert text.count("ArrowEvalPython") == (1 if key in CALLS_A_MODEL else 0)
    assert ("Python" in text) == (key in CALLS_A_MODEL)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    day = plan(all_queries()["dated_partition_scan"](spark, SF_DIR))
    assert "PartitionFilters: [isnotnull(crawl_date" in day and "= 240115)" in day
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in day
    several = all_queries()["dated_partition_join"](spark, SF_DIR)
    assert "dynamicpruning" in plan(several)
    counts = plan(all_queries()["label_share"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in counts


def test_statistics_shuffle_counts_not_rows(spark):
    text = plan(all_queries()["label_share"](spark, SF_DIR))
    assert "partial_count" in text and "Join" not in text


def test_small_dimensions_are_broadcast_by_size(spark):
    assert "BroadcastHashJoin" in plan(all_queries()["sector_lookup"](spark, SF_DIR))


def test_attach_runs_no_job_and_broadcasts_by_size(spark):
    big = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    small = big.groupBy("k").agg(F.max("id").alias("m"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("attach", "attach")
    joined = lk.attach(big, small, ["k"])
    assert not tracker.getJobIdsForGroup("attach")
    joined.collect()
    assert "BroadcastHashJoin" in plan(joined)


def test_attach_matches_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert lk.attach(rows, sizes, ["k"]).count() == 2


def test_a_hot_key_is_split_beyond_the_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997)
        rows = spark.range(300_000, numPartitions=16).select(hot.alias("k"), F.hash("id").alias("h"), F.xxhash64("id").alias("x"))
        joined = lk.attach(rows, rows.groupBy("k").agg(F.max("h").alias("m")), ["k"])
        assert len(joined.collect()) == 300_000
        assert "SortMergeJoin(skew=true)" in plan(joined)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
