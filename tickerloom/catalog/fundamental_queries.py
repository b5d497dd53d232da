"""Nested fundamentals, grades, targets and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickerloom.catalog.tables import GRADES, table
from tickerloom.constants import ENDPOINT_LIMITS
from tickerloom.functions.values import day_text, exact_mean, exact_sum, rounded
from tickerloom.operators import drift as dr, fundamentals as fd, ordering as od
from tickerloom.plans import collection as cl
from tickerloom.schemas import ENDPOINT_FIELDS


def _endpoint(data) -> F.Column:
    return F.struct(F.lit("").alias("description"), data.alias("data"))


def fundamentals(spark, sf) -> DataFrame:
    """One nested document per customer with orders.

    Each endpoint lists the customer's latest orders under its own rule, as
    many as the provider is asked for, so no list grows with the table. An order
    is tagged with the endpoints it may be in and ranked once per endpoint.
    """
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("symbol"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    tally = orders.groupBy("symbol").agg(
        *[F.count(F.when(F.col("o_orderpriority") == g, True)).alias(f"g{i}") for i, g in enumerate(GRADES)],
        F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"),
        rounded(exact_mean(F.col("o_totalprice")), 2).alias("mean"),
    )
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rules = {
        "analyst_estimates": (status == "F", ENDPOINT_LIMITS["analyst_estimates"]),
        "stock_grades": (F.lit(True), ENDPOINT_LIMITS["stock_grades"]),
        "stock_grades_historical": (F.lit(True), ENDPOINT_LIMITS["stock_grades_historical"]),
        "key_metrics_ttm": (status == "P", 1),
        "ratings_snapshot": (priority == GRADES[0], 1),
        "dcf_valuation": (priority == GRADES[1], 1),
        "earnings_report": (status == "O", ENDPOINT_LIMITS["earnings_report"]),
    }
    tags = [F.when(keep, F.struct(F.lit(e).alias("endpoint"), F.lit(n).alias("most"))) for e, (keep, n) in rules.items()]
    tagged = orders.select("*", F.inline(F.filter(F.array(*tags), lambda t: t.isNotNull())))
    newest = od.latest_rows(
        tagged, ["symbol", "endpoint"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], max(n for _, n in rules.values())
    ).where("rec_no <= most")
    order = F.struct(
        "rec_no", day_text(F.col("o_orderdate")).alias("date"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("grade"), F.col("o_orderstatus").alias("status"),
    )
    listed = newest.groupBy("symbol").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("endpoint") == e, order))).alias(f"latest_{e}") for e in rules
    ])
    rows = tally.join(listed, "symbol")

    name = F.col("symbol").cast("string").alias("symbol")

    def some(endpoint, record):
        return F.transform(F.col(f"latest_{endpoint}"), record)

    # the symbol is not repeated inside the records of the lists
    dated = lambda r, **more: F.struct(r["date"].alias("date"), *[c.alias(k) for k, c in more.items()])
    grade = lambda r: dated(r, newGrade=r["grade"], action=r["status"])
    return rows.select(
        "symbol",
        F.struct(
            _endpoint(F.array(F.struct(
                name, *[F.col(f"g{i}").alias(n) for i, n in enumerate(["strongBuy", "buy", "hold", "sell", "strongSell"])]
            ))).alias("grades_consensus"),
            _endpoint(F.array(F.struct(
                name, F.col("hi").alias("targetHigh"), F.col("lo").alias("targetLow"), F.col("mean").alias("targetConsensus")
            ))).alias("price_target_consensus"),
            _endpoint(some(
                "analyst_estimates",
                lambda r: dated(r, estimatedRevenueAvg=r["price"] * 10000, estimatedEpsAvg=r["price"] / 1000),
            )).alias("analyst_estimates"),
            _endpoint(some("stock_grades", grade)).alias("stock_grades"),
            _endpoint(some("stock_grades_historical", grade)).alias("stock_grades_historical"),
        ).alias("analyst"),
        F.struct(
            _endpoint(some("key_metrics_ttm", lambda r: F.struct(r["price"].alias("peRatioTTM")))).alias("key_metrics_ttm"),
        ).alias("fundamental"),
        F.struct(
            _endpoint(some(
                "ratings_snapshot",
                lambda r: dated(r, rating=r["grade"], ratingScore=F.lit(None).cast("bigint")),
            )).alias("ratings_snapshot"),
            _endpoint(some("dcf_valuation", lambda r: dated(r, dcf=r["price"]))).alias("dcf_valuation"),
        ).alias("valuation"),
        F.struct(
            _endpoint(some(
                "earnings_report", lambda r: dated(r, revenue=r["price"])
            )).alias("earnings_report"),
        ).alias("market_context"),
    )


def slim_projection(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id", fd.slim(F.col("props"), {"k": "bigint"})["k"].alias("k"), fd.slim(F.col("props"), None).alias("raw")
    )


def field_coverage(spark, sf):
    declared = {"k": "bigint", "score": "double", "period": "string"}
    return fd.field_coverage(table(spark, sf, "events").select(fd.slim(F.col("props"), declared).alias("record")), "record")


def endpoint_flatten(spark, sf):
    shown = "date string, targetHigh double, estimatedRevenueAvg double, peRatioTTM double, dcf double, revenue double, strongBuy double"
    flat = fd.flatten(fundamentals(spark, sf)).withColumn("r", F.from_json("record", shown))
    number = F.coalesce(*[F.col("r")[n] for n in [
        "targetHigh", "estimatedRevenueAvg", "peRatioTTM", "dcf", "revenue", "strongBuy",
    ]])
    return flat.select(
        "symbol", "section", "endpoint", F.col("rec_no").cast("bigint").alias("rec_no"),
        F.col("r.date").alias("date"), number.alias("value"),
    )


def nested_first_record(spark, sf):
    docs = fundamentals(spark, sf)
    newest = fd.first_record(docs, "analyst", "stock_grades")
    dcf = fd.first_record(docs, "valuation", "dcf_valuation")
    absent = F.size(fd.records(docs, "valuation", "owner_earnings")).cast("bigint")
    return docs.select(
        "symbol", newest["date"].alias("date"), newest["newGrade"].alias("grade"),
        F.coalesce(dcf["dcf"], F.lit(0.0)).alias("dcf"), absent.alias("owner_records"),
    )


def endpoint_ok_counts(spark, sf):
    return fd.ok_counts(fundamentals(spark, sf))


def run_summary(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), "c_nationkey")
    nations = table(spark, sf, "nation")
    sectors = customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        "symbol", F.col("n_name").alias("sector")
    )
    orders = table(spark, sf, "orders").withColumn("symbol", F.col("o_custkey"))
    text = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    sizes = orders.groupBy("symbol").agg(F.sum(F.octet_length(text)).alias("size_bytes"))
    done = orders.where(F.col("o_totalprice") > 480000)
    return fd.run_summary(fd.ok_counts(fundamentals(spark, sf)), sectors, sizes, done, "symbol")


# a small set of endpoints, in the shape of the full declaration
COLLECTED = {
    "analyst": {"grades_consensus": {"symbol": "string", "buy": "bigint", "hold": "bigint"}},
    "valuation": {"dcf_valuation": {"symbol": "string", "dcf": "double"}, "ratings_snapshot": {"rating": "string"}},
    "market_context": {"treasury_rates": {"year10": "double"}},
}


def assembled_fundamentals(spark, sf):
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    responses = table(spark, sf, "events").select(
        F.when(kind != "error", F.col("user_id")).alias("symbol"),
        F.when(kind == "view", F.lit("grades_consensus")).when(kind == "click", F.lit("dcf_valuation"))
        .when(kind == "purchase", F.lit("ratings_snapshot")).when(kind == "error", F.lit("treasury_rates"))
        .otherwise(F.lit("undeclared")).alias("endpoint"),
        F.when(kind == "view", F.concat(F.lit('[{"symbol": "s", "buy": '), k, F.lit(', "other": 1}]')))
        .when(kind == "click", F.concat(F.lit('[{"dcf": '), k, F.lit(".5}, {}]")))
        .when(kind == "purchase", F.lit("[]"))
        .otherwise(F.concat(F.lit('[{"year10": '), k, F.lit("}]"))).alias("body"),
        F.struct("ts", "event_id").alias("at"),
    )
    sectors = table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("sector"))
    docs = cl.assemble(
        responses, sectors.where(F.col("sector") != "HOUSEHOLD"), F.lit("2024-02-01"),
        sections=COLLECTED, shared=("treasury_rates",),
    )
    return fd.with_ok_counts(docs).select(
        "symbol", "meta.sector", "ok", "total",
        fd.first_record(docs, "analyst", "grades_consensus")["buy"].alias("buy"),
        fd.first_record(docs, "valuation", "dcf_valuation")["dcf"].alias("dcf"),
        fd.first_record(docs, "market_context", "treasury_rates")["year10"].alias("year10"),
    )


def endpoint_drift(spark, sf):
    """Responses of all endpoints in turn, in the forms in which providers change them."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    names = F.array(*[F.lit(e) for members in ENDPOINT_FIELDS.values() for e in members])
    responses = table(spark, sf, "events").select(
        F.element_at(names, (F.col("event_id") % F.size(names) + 1).cast("int")).alias("endpoint"),
        F.when(kind == "view", F.concat(F.lit('[{"symbol": "s", "date": "2024-01-01", "extra": '), k, F.lit("}, 7]")))
        .when(kind == "click", F.concat(F.lit('{"symbol": '), k, F.lit(', "period": null, "revenue": '), k, F.lit(', "eps": '), k, F.lit(".25}")))
        .when(kind == "purchase", F.lit('[{"date": null, "nested": {"a": [1]}, "dcf": "1.5", "list": []}, {}]'))
        .when(kind == "signup", F.lit("[]"))
        .otherwise(F.lit("Error Message: limit reached")).alias("body"),
    )
    return dr.field_drift(responses)


def _grade_tally(spark, sf):
    return fd.grade_tally(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", GRADES)


def grade_consensus(spark, sf):
    names = ["strong_buy", "buy", "hold", "sell", "strong_sell"]
    return _grade_tally(spark, sf).withColumnsRenamed(dict(zip(GRADES, names)))


def grade_share(spark, sf):
    return fd.grade_shares(_grade_tally(spark, sf), "o_custkey", GRADES)


def grade_change_view(spark, sf):
    action = (
        F.when(F.col("o_orderstatus") == "F", F.lit("Upgrade"))
        .when(F.col("o_orderstatus") == "O", F.lit("DOWNGRADE"))
        .otherwise(F.lit("maintained"))
    )
    grades = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("newGrade"), action.alias("action"),
    )
    return fd.grade_changes(grades)


def grade_history(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    before = od.previous_value(
        orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderpriority", "previous_grade"
    )
    return before.select(
        "o_custkey", "o_orderkey", "previous_grade", F.col("o_orderpriority").alias("new_grade"),
        fd.grade_action(F.col("previous_grade"), F.col("o_orderpriority"), GRADES).alias("action"),
    )


def target_consensus(spark, sf):
    orders = table(spark, sf, "orders")
    median = od.exact_median(orders, ["o_custkey"], "o_totalprice", "o_orderkey", "_median")
    return fd.target_range(orders, "o_custkey", "o_totalprice").join(median, "o_custkey").withColumn(
        "target_median", rounded(F.col("_median"), 3)
    ).drop("_median")


def target_upside(spark, sf):
    return fd.target_upside(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderkey")


def target_summary(spark, sf):
    return fd.target_summary(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderdate")


def earnings_surprise(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    latest = od.latest_rows(
        orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], ENDPOINT_LIMITS["earnings_report"]
    )
    # only lines of the kept orders are summed; a report without any has no actual
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    billed = lines.join(latest.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(
        rounded(exact_sum(F.col("l_extendedprice")), 2).alias("actual")
    )
    return latest.join(billed, "o_orderkey", "left").select(
        "o_custkey", "rec_no", "o_orderkey", F.col("o_totalprice").alias("estimate"), "actual",
        fd.surprise(F.col("actual"), F.col("o_totalprice")).alias("surprise_pct"),
    )


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def yoy_growth(spark, sf):
    yearly = table(spark, sf, "lineitem").groupBy(
        "l_suppkey", F.year("l_shipdate").cast("bigint").alias("year")
    ).agg(rounded(exact_sum(_revenue()), 2).alias("revenue"))
    return fd.growth(yearly, "l_suppkey", "year", "revenue")


def ttm_revenue(spark, sf):
    quarter = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).cast("bigint")
    quarterly = table(spark, sf, "lineitem").groupBy("l_suppkey", quarter.alias("quarter")).agg(
        rounded(exact_sum(_revenue()), 2).alias("revenue")
    )
    return fd.trailing_total(quarterly, "l_suppkey", "quarter", "revenue")


def sector_snapshot(spark, sf):
    # summed per customer and day first: a customer with very many orders
    # brings few rows to the join
    daily = table(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(
        exact_sum(F.col("o_totalprice")).alias("s"), F.count("o_totalprice").alias("n")
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        daily.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("sector"), day_text(F.col("day")).alias("day"))
        .agg(F.sum("n").alias("n"), rounded(exact_sum(F.col("s")) / F.sum("n"), 2).alias("mean_price"))
    )


QUERIES = {
    f.__name__: f
    for f in [
        slim_projection, field_coverage, endpoint_flatten, nested_first_record, endpoint_ok_counts,
        run_summary, assembled_fundamentals, endpoint_drift, grade_consensus, grade_share, grade_change_view, grade_history, target_consensus,
        target_upside, target_summary, earnings_surprise, yoy_growth, ttm_revenue, sector_snapshot,
    ]
}


def _sum(expr: str, only: str = "true") -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(28,6))) FILTER ({only}) AS DOUBLE)"


def _mean(expr: str, only: str = "true") -> str:
    return f"{_sum(expr, only)} / count(*) FILTER ({only})"


def _round(expr: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {expr}) AS DOUBLE)"


def _plain(expr: str) -> str:
    """A price as text: whole numbers without a decimal point."""
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


_PLACED = """placed AS (
  SELECT o_custkey AS symbol, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS grade,
         o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders),
tally AS (
  SELECT o_custkey AS symbol, """ + ", ".join(
    f"count(*) FILTER (o_orderpriority = '{g}') AS g{i}" for i, g in enumerate(GRADES)
) + f""", max(o_totalprice) AS hi, min(o_totalprice) AS lo, {_round(_mean('o_totalprice'), 2)} AS mean FROM orders GROUP BY ALL)"""
_PLACED_DOC = _PLACED.replace("tally AS", "grade_tally AS")


def _listed(where: str, n: int) -> str:
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS rec_no FROM placed WHERE {where}) q "
        f"WHERE q.rec_no <= {n})"
    )


_SYMBOLS = "(SELECT DISTINCT symbol FROM placed)"
_RECORDS = f"""{_PLACED},
recs AS (
  SELECT symbol, 'analyst' AS section, 'grades_consensus' AS endpoint, 1 AS rec_no, NULL AS date, g0::DOUBLE AS value FROM tally
  UNION ALL SELECT symbol, 'analyst', 'price_target_consensus', 1, NULL, hi FROM tally
  UNION ALL SELECT symbol, 'analyst', 'analyst_estimates', rec_no, date, price * 10000 FROM {_listed("status = 'F'", 3)}
  UNION ALL SELECT symbol, 'analyst', 'stock_grades', rec_no, date, NULL FROM {_listed("true", 10)}
  UNION ALL SELECT symbol, 'analyst', 'stock_grades_historical', rec_no, date, NULL FROM {_listed("true", 20)}
  UNION ALL SELECT symbol, 'fundamental', 'key_metrics_ttm', rec_no, NULL, price FROM {_listed("status = 'P'", 1)}
  UNION ALL SELECT symbol, 'valuation', 'ratings_snapshot', rec_no, date, NULL FROM {_listed("grade = '1-URGENT'", 1)}
  UNION ALL SELECT symbol, 'valuation', 'dcf_valuation', rec_no, date, price FROM {_listed("grade = '2-HIGH'", 1)}
  UNION ALL SELECT symbol, 'market_context', 'earnings_report', rec_no, date, price FROM {_listed("status = 'O'", 8)}),
ends AS (SELECT DISTINCT section, endpoint FROM recs),
oks AS (
  SELECT symbol, count(DISTINCT endpoint) AS ok, 9::BIGINT AS total FROM recs GROUP BY symbol)"""

ANALYST_BLOCK_SQL = f"""{_PLACED_DOC},
ablock AS (
  SELECT t.symbol, concat_ws(chr(10),
    '▶ 애널리스트 등급 합산' || chr(10) || '  Strong Buy: ' || g0 || '  Buy: ' || g1 || '  Hold: ' || g2 || '  Sell: ' || g3 || '  Strong Sell: ' || g4,
    '▶ 목표주가 컨센서스' || chr(10) || '  High: $' || {_plain('hi')} || '  Low: $' || {_plain('lo')} || '  Consensus: $' || {_plain('mean')} || '  Median: $N/A',
    '▶ 실적 추정치 (' || substring(f.date, 1, 7) || ')' || chr(10) || '  예상 매출: $' || printf('%.1f', f.price * 10000 / 1e9) || 'B  예상 EPS: $' || printf('%.2f', f.price / 1000),
    '▶ DCF 내재가치' || chr(10) || '  DCF: $' || {_plain('d.price')} || '  현재가: $N/A',
    '▶ FMP 종합 등급' || chr(10) || '  등급: ' || u.grade || '  점수: N/A',
    '▶ 핵심 밸류에이션 (TTM)' || chr(10) || '  P/E: ' || {_plain('p.price')} || '  P/B: N/A  EV/EBITDA: N/A  ROE: N/A') AS analyst_block
  FROM grade_tally t LEFT JOIN {_listed("status = 'F'", 1)} f USING (symbol)
  LEFT JOIN {_listed("grade = '2-HIGH'", 1)} d ON d.symbol = t.symbol
  LEFT JOIN {_listed("grade = '1-URGENT'", 1)} u ON u.symbol = t.symbol
  LEFT JOIN {_listed("status = 'P'", 1)} p ON p.symbol = t.symbol)"""

_GRADE_COLUMNS = ["strong_buy", "buy", "hold", "sell", "strong_sell"]
_YEARLY = _round(_sum("l_extendedprice * (1 - l_discount)"), 2)

SQL = {
    "slim_projection": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props AS raw FROM events",
    "field_coverage": """
SELECT 'k' AS field, count(json_extract(props, '$.k')) AS present, count(*) AS rows FROM events
UNION ALL SELECT 'score', count(json_extract(props, '$.score')), count(*) FROM events
UNION ALL SELECT 'period', count(json_extract(props, '$.period')), count(*) FROM events""",
    "endpoint_flatten": f"""WITH {_RECORDS}
SELECT s.symbol, e.section, e.endpoint, CAST(r.rec_no AS BIGINT) AS rec_no, r.date, r.value
FROM {_SYMBOLS} s CROSS JOIN ends e
LEFT JOIN recs r ON r.symbol = s.symbol AND r.endpoint = e.endpoint""",
    "nested_first_record": f"""WITH {_PLACED}
SELECT s.symbol, n.date, n.grade, coalesce(d.price, 0) AS dcf, 0::BIGINT AS owner_records
FROM {_SYMBOLS} s JOIN {_listed("true", 1)} n USING (symbol) LEFT JOIN {_listed("grade = '2-HIGH'", 1)} d ON d.symbol = s.symbol""",
    "endpoint_ok_counts": f"WITH {_RECORDS} SELECT symbol, ok, total FROM oks",
    "run_summary": f"""WITH {_RECORDS},
sizes AS (
  SELECT o_custkey AS symbol, sum(octet_length(encode(o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority))) AS b,
         bool_or(o_totalprice > 480000) AS done FROM orders GROUP BY o_custkey)
SELECT o.symbol, coalesce(n.n_name, '') AS sector, o.ok, o.total, CAST(floor(z.b / 1024) AS BIGINT) AS size_kb,
       CASE WHEN z.done THEN 'SKIP' ELSE 'NEW' END AS status
FROM oks o JOIN sizes z USING (symbol) LEFT JOIN customer c ON c.c_custkey = o.symbol LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "endpoint_drift": """
WITH declared(place, section, endpoint, field, declared) AS (VALUES """ + ", ".join(
        f"({place}, '{section}', '{endpoint}', '{field}', '{kind}')"
        for place, (section, endpoint, fields) in enumerate((s, e, f) for s, members in ENDPOINT_FIELDS.items() for e, f in members.items())
        for field, kind in fields.items()
    ) + """),
b AS (SELECT DISTINCT place, endpoint FROM declared),
r AS (
  SELECT endpoint, event_type, json_extract(props, '$.k')::VARCHAR AS k FROM events JOIN b ON place = event_id % (SELECT count(*) FROM b)),
m AS (
  SELECT endpoint, unnest(CASE event_type
    WHEN 'view' THEN ['{"symbol": "s", "date": "2024-01-01", "extra": ' || k || '}', '7']
    WHEN 'click' THEN ['{"symbol": ' || k || ', "period": null, "revenue": ' || k || ', "eps": ' || k || '.25}']
    WHEN 'purchase' THEN ['{"date": null, "nested": {"a": [1]}, "dcf": "1.5", "list": []}', '{}']
    WHEN 'signup' THEN [] ELSE [NULL] END) AS m FROM r),
f AS (
  SELECT endpoint, field, lower(json_type(m, '$.' || field)) AS t FROM (SELECT endpoint, m, unnest(json_keys(m)) AS field FROM m WHERE json_type(m) = 'OBJECT')
  UNION ALL SELECT endpoint, NULL, coalesce(lower(json_type(m)), 'unreadable') FROM m WHERE m IS NULL OR json_type(m) <> 'OBJECT'),
a AS (
  SELECT endpoint, field, string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (kind <> 'null') AS seen, count(*) FILTER (kind <> 'null') AS filled
  FROM (SELECT endpoint, field, CASE t WHEN 'ubigint' THEN 'bigint' WHEN 'varchar' THEN 'string' ELSE t END AS kind FROM f) GROUP BY ALL)
SELECT section, coalesce(a.endpoint, d.endpoint) AS endpoint, coalesce(a.field, d.field) AS field, declared, coalesce(seen, '') AS seen, coalesce(filled, 0) AS filled,
       CASE WHEN declared IS NULL THEN CASE WHEN a.field IS NULL THEN 'unreadable' ELSE 'undeclared' END
            WHEN coalesce(filled, 0) = 0 THEN 'absent'
            WHEN seen = declared OR declared = 'double' AND seen IN ('bigint', 'bigint,double') THEN 'ok' ELSE 'retyped' END AS status
FROM a FULL JOIN declared d ON a.endpoint = d.endpoint AND a.field = d.field""",
    "assembled_fundamentals": """
WITH k AS (SELECT user_id AS symbol, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, (ts, event_id) AS moment FROM events),
own AS (
  SELECT symbol, arg_max(k, moment) FILTER (event_type = 'view') AS buy, arg_max(k, moment) FILTER (event_type = 'click') AS dcf
  FROM k WHERE event_type <> 'error' GROUP BY symbol)
SELECT symbol, coalesce(c_mktsegment, '') AS sector,
       (buy IS NOT NULL)::BIGINT + (dcf IS NOT NULL)::BIGINT + 1 AS ok, 4::BIGINT AS total, buy, dcf + 0.5::DOUBLE AS dcf,
       (SELECT arg_max(k, moment) FROM k WHERE event_type = 'error')::DOUBLE AS year10
FROM own LEFT JOIN customer ON c_custkey = symbol AND c_mktsegment <> 'HOUSEHOLD'""",
    "grade_consensus": "SELECT o_custkey, " + ", ".join(
        f"count(*) FILTER (o_orderpriority = '{g}') AS {n}" for g, n in zip(GRADES, _GRADE_COLUMNS)
    ) + " FROM orders GROUP BY o_custkey",
    "grade_share": """
SELECT t.o_custkey, g.grade, coalesce(c.n, 0) AS n, CAST(printf('%.0f', coalesce(c.n, 0) / t.total * 100) AS BIGINT) AS pct
FROM (SELECT o_custkey, count(*) AS total FROM orders GROUP BY ALL) t
CROSS JOIN (SELECT DISTINCT o_orderpriority AS grade FROM orders) g
LEFT JOIN (SELECT o_custkey, o_orderpriority AS grade, count(*) AS n FROM orders GROUP BY ALL) c
  ON c.o_custkey = t.o_custkey AND c.grade = g.grade""",
    "grade_change_view": """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS "날짜", o_orderpriority AS "현재 등급",
       CASE o_orderstatus WHEN 'F' THEN '🟢 상향' WHEN 'O' THEN '🔴 하향' ELSE 'maintained' END AS "변경" FROM orders""",
    "grade_history": """
WITH h AS (
  SELECT o_custkey, o_orderkey, o_orderpriority AS new_grade,
         lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_grade FROM orders)
SELECT o_custkey, o_orderkey, previous_grade, new_grade,
       CASE WHEN previous_grade IS NULL THEN 'initiation' WHEN new_grade < previous_grade THEN 'upgrade'
            WHEN new_grade > previous_grade THEN 'downgrade' ELSE 'reiterated' END AS action FROM h""",
    "target_consensus": f"""
SELECT o_custkey, max(o_totalprice) AS target_high, min(o_totalprice) AS target_low,
       {_round(_mean('o_totalprice'), 2)} AS target_consensus, {_round('median(o_totalprice)', 3)} AS target_median
FROM orders GROUP BY o_custkey""",
    "target_upside": f"""
WITH t AS (
  SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price, {_round(_mean('o_totalprice'), 2)} AS target_consensus
  FROM orders GROUP BY o_custkey)
SELECT *, {_round('(target_consensus - last_price) / last_price * 100', 2)} AS upside_pct FROM t""",
    "target_summary": "WITH m AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS mx FROM orders GROUP BY ALL) SELECT o_custkey, " + ", ".join(
        f"count(*) FILTER ({w}) AS {n}, {_round(_mean('o_totalprice', w), 2)} AS {n}_avg"
        for n, w in [
            ("last_month", "CAST(o_orderdate AS DATE) > mx - INTERVAL 1 MONTH"),
            ("last_quarter", "CAST(o_orderdate AS DATE) > mx - INTERVAL 3 MONTH"),
            ("last_year", "CAST(o_orderdate AS DATE) > mx - INTERVAL 12 MONTH"),
            ("all_time", "true"),
        ]
    ) + " FROM orders JOIN m USING (o_custkey) GROUP BY o_custkey",
    "earnings_surprise": f"""
WITH latest AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rec_no FROM orders QUALIFY rec_no <= 8),
billed AS (SELECT l_orderkey, {_round(_sum('l_extendedprice'), 2)} AS actual FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey, rec_no, o_orderkey, o_totalprice AS estimate, actual,
       CASE WHEN actual IS NOT NULL THEN {_round('(actual - o_totalprice) / o_totalprice * 100', 2)} END AS surprise_pct
FROM latest LEFT JOIN billed ON l_orderkey = o_orderkey""",
    "yoy_growth": f"""
WITH y AS (SELECT l_suppkey, year(l_shipdate) AS year, {_YEARLY} AS revenue FROM lineitem GROUP BY ALL),
p AS (SELECT y.*, b.revenue AS previous FROM y LEFT JOIN y b ON b.l_suppkey = y.l_suppkey AND b.year = y.year - 1)
SELECT *, CASE WHEN previous <> 0 THEN {_round('(revenue - previous) / previous * 100', 2)} END AS growth_pct FROM p""",
    "ttm_revenue": f"""
WITH q AS (SELECT l_suppkey, year(l_shipdate) * 4 + quarter(l_shipdate) AS quarter, {_YEARLY} AS revenue FROM lineitem GROUP BY ALL)
SELECT q.l_suppkey, q.quarter, q.revenue, {_round('CAST(sum(CAST(b.revenue AS DECIMAL(28,6))) AS DOUBLE)', 2)} AS ttm
FROM q JOIN q b ON b.l_suppkey = q.l_suppkey AND b.quarter BETWEEN q.quarter - 3 AND q.quarter
GROUP BY ALL HAVING count(*) = 4""",
    "sector_snapshot": f"""
SELECT n_name AS sector, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, {_round(_mean('o_totalprice'), 2)} AS mean_price
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""",
}
