"""Lookups, existence joins, file selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.tables import table
from tickerloom.functions.values import clock_text, stamp_text
from tickerloom.operators import lookups as lk
from tickerloom.session import durable_path
from tickerloom.sources.landing import is_dated_analysis, is_raw_file, read_days
from tickerloom.sources.sinks import write_days


def _symbols(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"))


def sector_lookup(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), "c_nationkey")
    sectors = (
        table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .where(F.col("r_name") != "ASIA")
        .select(F.col("n_nationkey").alias("c_nationkey"), F.concat_ws(" / ", "r_name", "n_name").alias("sector"))
    )
    names = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("symbol"), F.col("c_name").alias("company")
    )
    named = lk.look_up(customers, sectors, "c_nationkey", "sector", F.lit(""))
    return lk.look_up(named, names, "symbol", "company", F.col("symbol").cast("string")).select("symbol", "sector", "company")


def shared_context(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per_region = nations.groupBy("r_name").agg(F.count("*").alias("n"))
    rates = per_region.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "r_name", F.col("n").cast("string")))), ",").alias("rates"))
    sectors = nations.agg(F.count("*").alias("sectors"))
    return lk.with_shared(_symbols(spark, sf), rates=rates, sectors=sectors)


def availability_badge(spark, sf):
    results = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("symbol"), F.col("o_orderstatus").alias("model")
    )
    return lk.availability(_symbols(spark, sf), results, "symbol", "model", "F", "O")


def _done(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"))


def todo_anti(spark, sf):
    return lk.to_do(_symbols(spark, sf), _done(spark, sf), "symbol")


def done_semi(spark, sf):
    return lk.already_done(_symbols(spark, sf), _done(spark, sf), "symbol")


def missing_inputs(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("symbol"), "event_type", "ts")
    return lk.missing_inputs(_symbols(spark, sf), events, "symbol", F.col("event_type") == "purchase")


def _landed_by_day(spark, sf):
    """The feed as it is landed: parquet in one folder per day."""
    path = durable_path(spark)
    write_days(table(spark, sf, "events"), path, stamp_text(F.col("ts")))
    return path


def _file(rows):
    file = F.concat(F.col("user_id").cast("string"), F.lit("_"), F.col("crawl_date"), F.lit(".csv"))
    return rows.select("event_id", clock_text(F.col("ts")).alias("date"), file.alias("file"))


def dated_partition_scan(spark, sf):
    return _file(read_days(spark, _landed_by_day(spark, sf), stamp="240115"))


def dated_partition_join(spark, sf):
    """The news of days on which errors outnumber purchases."""
    kind = F.col("event_type")
    per_day = table(spark, sf, "events").groupBy(stamp_text(F.col("ts")).alias("crawl_date")).agg(
        F.count_if(kind == "error").alias("errors"), F.count_if(kind == "purchase").alias("purchases")
    )
    return _file(read_days(spark, _landed_by_day(spark, sf), days=per_day.where("errors > purchases")))


def latest_file_per_symbol(spark, sf):
    stamp = stamp_text(F.col("ts"))
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", F.concat(F.lit("_"), stamp, F.lit("_translated.csv")))
        .when(kind == "click", F.concat(F.lit("_analysis_modelb_"), stamp, F.lit(".json")))
        .when(kind == "error", F.lit("_analysis_modelb331.json"))
        .otherwise(F.concat(F.lit("_"), stamp, F.lit(".csv")))
    )
    files = table(spark, sf, "events").select(
        F.col("user_id").alias("symbol"),
        F.concat(F.lit("/landed/"), F.col("user_id").cast("string"), name).alias("path"),
    )
    path = F.col("path")
    return lk.latest_paths(files, "symbol", "path", {
        "latest_raw": F.endswith(path, F.lit(".csv")) & is_raw_file(path),
        "latest_analysis": is_dated_analysis(path, "modelb"),
    })


QUERIES = {
    f.__name__: f
    for f in [
        sector_lookup, shared_context, availability_badge, todo_anti, done_semi, missing_inputs,
        dated_partition_scan, dated_partition_join, latest_file_per_symbol,
    ]
}

SQL = {
    "sector_lookup": """
SELECT c.c_custkey AS symbol, CASE WHEN r.r_name <> 'ASIA' THEN r.r_name || ' / ' || n.n_name ELSE '' END AS sector,
       CASE WHEN c.c_acctbal > 0 THEN c.c_name ELSE CAST(c.c_custkey AS VARCHAR) END AS company
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "shared_context": """
WITH p AS (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT c_custkey AS symbol, (SELECT string_agg(r_name || ':' || n, ',' ORDER BY r_name || ':' || n) FROM p) AS rates,
       (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey) AS sectors FROM customer""",
    "availability_badge": """
WITH r AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders),
b AS (SELECT o_custkey, string_agg(o_orderstatus, ' · ' ORDER BY o_orderstatus) AS badge FROM r WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey)
SELECT c_custkey AS symbol, coalesce(badge, '') AS badge FROM customer LEFT JOIN b ON o_custkey = c_custkey""",
    "todo_anti": """
SELECT c_custkey AS symbol FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "done_semi": """
SELECT c_custkey AS symbol FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "missing_inputs": """
WITH seen AS (
  SELECT user_id, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY user_id)
SELECT c_custkey AS symbol, CASE WHEN ok IS NULL THEN 'no input' ELSE 'no valid rows' END AS reason
FROM customer LEFT JOIN seen ON user_id = c_custkey WHERE NOT coalesce(ok, false)""",
    "dated_partition_scan": """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, user_id || '_240115.csv' AS file FROM events
WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'""",
    "dated_partition_join": """
WITH d AS (SELECT strftime(ts, '%y%m%d') AS stamp FROM events GROUP BY ALL
           HAVING count(*) FILTER (event_type = 'error') > count(*) FILTER (event_type = 'purchase'))
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, user_id || '_' || stamp || '.csv' AS file
FROM events JOIN d ON strftime(ts, '%y%m%d') = stamp""",
    "latest_file_per_symbol": """
WITH f AS (
  SELECT user_id AS symbol, event_type, '/landed/' || user_id AS stem, strftime(ts, '%y%m%d') AS stamp FROM events)
SELECT symbol, max(CASE WHEN event_type IN ('purchase', 'signup') THEN stem || '_' || stamp || '.csv' END) AS latest_raw,
       max(CASE WHEN event_type = 'click' THEN stem || '_analysis_modelb_' || stamp || '.json' END) AS latest_analysis
FROM f GROUP BY symbol""",
}
