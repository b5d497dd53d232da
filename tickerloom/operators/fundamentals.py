"""Nested per-symbol fundamentals: access, flattening, coverage, tallies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tickerloom.constants import ACTION_DISPLAY, GRADE_CHANGE_COLUMNS
from tickerloom.functions.values import day_text, display, exact_mean, exact_sum, rounded, share_percent
from tickerloom.operators.news import select_present

SECTION_NAMES = ("analyst", "fundamental", "valuation", "market_context")


def _endpoints(df: DataFrame) -> list[tuple[str, str, T.ArrayType]]:
    """(section, endpoint, type of its record list) present in the schema."""
    found = []
    for section in SECTION_NAMES:
        if section in df.columns:
            for endpoint in df.schema[section].dataType.fields:
                if "data" in endpoint.dataType.names:
                    found.append((section, endpoint.name, endpoint.dataType["data"].dataType))
    return found


def records(df: DataFrame, section: str, endpoint: str) -> Column:
    """The endpoint's records; an empty array if any level is missing."""
    for s, e, kind in _endpoints(df):
        if (s, e) == (section, endpoint):
            return F.coalesce(F.col(s)[e]["data"], F.array().cast(kind))
    return F.array().cast("array<struct<symbol: string>>")


def record_fields(df: DataFrame, section: str, endpoint: str) -> dict[str, T.DataType]:
    for s, e, kind in _endpoints(df):
        if (s, e) == (section, endpoint):
            return {f.name: f.dataType for f in kind.elementType.fields}
    return {}


def first_record(df: DataFrame, section: str, endpoint: str) -> Column:
    return F.try_element_at(records(df, section, endpoint), F.lit(1))


def is_ok(data: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.size(data) > 0, F.lit(False))


def flatten(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """One row per record: symbol, section, endpoint, place, record as JSON.

    An endpoint without records keeps one row with a null record.
    """
    cells = F.array(*[
        F.struct(
            F.lit(section).alias("section"), F.lit(endpoint).alias("endpoint"),
            F.transform(records(df, section, endpoint), lambda r: F.to_json(r)).alias("data"),
        )
        for section, endpoint, _ in _endpoints(df)
    ])
    return df.select(symbol, F.inline(cells)).select(
        symbol, "section", "endpoint", F.posexplode_outer("data").alias("pos", "record")
    ).withColumn("rec_no", F.col("pos") + 1).drop("pos")


def with_ok_counts(df: DataFrame) -> DataFrame:
    """The documents with ``ok``, their endpoints with data, and ``total``, how many there are."""
    endpoints = _endpoints(df)
    ok = sum((is_ok(records(df, s, e)).cast("bigint") for s, e, _ in endpoints), F.lit(0).cast("bigint"))
    return df.withColumns({"ok": ok, "total": F.lit(len(endpoints)).cast("bigint")})


def ok_counts(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Endpoints with data per symbol, and how many there are in all."""
    return with_ok_counts(df).select(symbol, "ok", "total")


def run_summary(ok: DataFrame, sectors: DataFrame, sizes: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One line per symbol of a collection run."""
    marked = done.select(key).distinct().withColumn("_done", F.lit(True))
    return (
        ok.join(sectors, key, "left").join(sizes, key, "left").join(marked, key, "left")
        .select(
            key,
            F.coalesce("sector", F.lit("")).alias("sector"),
            "ok", "total",
            F.floor(F.coalesce("size_bytes", F.lit(0)) / 1024).cast("bigint").alias("size_kb"),
            F.when(F.col("_done"), F.lit("SKIP")).otherwise(F.lit("NEW")).alias("status"),
        )
    )


def slim(raw: Column, fields: Mapping[str, str] | None) -> Column:
    """Keep the declared fields of a JSON record; without a declaration the
    text passes through."""
    if fields is None:
        return raw
    ddl = "struct<" + ", ".join(f"`{n}`: {t}" for n, t in fields.items()) + ">"
    return F.from_json(raw, ddl)


def field_coverage(df: DataFrame, record: str) -> DataFrame:
    """Rows that fill each declared field; 0 means declared but never seen."""
    names = df.schema[record].dataType.names
    counted = df.agg(
        F.count("*").alias("rows"), *[F.count(F.col(record)[n]).alias(f"_{i}") for i, n in enumerate(names)]
    )
    cells = F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"_{i}").alias("present")) for i, n in enumerate(names)
    ])
    return counted.select("rows", F.inline(cells)).select("field", "present", "rows")


# --- grades and targets -------------------------------------------------------

def grade_tally(grades: DataFrame, symbol: str, grade: str, names: Sequence[str]) -> DataFrame:
    """One column per grade, in one pass."""
    return grades.groupBy(symbol).agg(*[
        F.count(F.when(F.col(grade) == name, True)).alias(name) for name in names
    ])


def grade_shares(tally: DataFrame, symbol: str, names: Sequence[str]) -> DataFrame:
    """Grade columns as rows with a whole-percent share; no grades give 0."""
    counts = [F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names]
    total = sum(counts[1:], counts[0])
    cells = F.array(*[F.struct(F.lit(n).alias("grade"), c.alias("n")) for n, c in zip(names, counts)])
    return tally.withColumn("total", total).select(symbol, "total", F.inline(cells)).select(
        symbol, "grade", "n",
        rounded(share_percent(F.col("n"), F.col("total")), 0).cast("bigint").alias("pct"),
    )


def grade_changes(grades: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Latest grade changes as shown: day text, action names, column names.
    ``keep`` names columns that stay in front as they are."""
    shown = grades
    if "date" in grades.columns:
        shown = shown.withColumn("date", day_text(F.col("date")))
    if "action" in grades.columns:
        shown = shown.withColumn("action", display(F.col("action"), ACTION_DISPLAY, lower=True))
    return select_present(shown, {**{c: c for c in keep}, **GRADE_CHANGE_COLUMNS})


def grade_action(previous: Column, new: Column, ranked: Sequence[str]) -> Column:
    """Name of the step from one grade to the next; ``ranked`` is best first."""
    place = lambda grade: F.array_position(F.lit(list(ranked)), grade)
    return (
        F.when(previous.isNull(), F.lit("initiation"))
        .when(place(new) < place(previous), F.lit("upgrade"))
        .when(place(new) > place(previous), F.lit("downgrade"))
        .otherwise(F.lit("reiterated"))
    )


def target_range(targets: DataFrame, symbol: str, price: str) -> DataFrame:
    return targets.groupBy(symbol).agg(
        F.max(price).alias("target_high"),
        F.min(price).alias("target_low"),
        rounded(exact_mean(F.col(price)), 2).alias("target_consensus"),
    )


def target_upside(targets: DataFrame, symbol: str, price: str, day: str, unique: str) -> DataFrame:
    """Latest price against the mean target."""
    return targets.groupBy(symbol).agg(
        F.max_by(price, F.struct(day, unique)).alias("last_price"),
        rounded(exact_mean(F.col(price)), 2).alias("target_consensus"),
    ).withColumn(
        "upside_pct",
        F.when(
            F.col("last_price") != 0,
            rounded((F.col("target_consensus") - F.col("last_price")) / F.col("last_price") * 100, 2),
        ),
    )


def target_summary(targets: DataFrame, symbol: str, price: str, ts: str) -> DataFrame:
    """Count and mean of the last month, quarter, year and of all time, seen
    from each symbol's last day. Prices are summed per day first, so the
    look-back runs over at most one row per symbol and calendar day."""
    daily = targets.groupBy(symbol, F.to_date(ts).alias("day")).agg(
        F.count(price).alias("n"), exact_sum(F.col(price)).alias("s")
    ).withColumn("_last", F.max("day").over(Window.partitionBy(symbol)))
    spans = {"last_month": 1, "last_quarter": 3, "last_year": 12, "all_time": None}
    out = []
    for name, months in spans.items():
        kept = F.lit(True) if months is None else F.col("day") > F.add_months("_last", -months)
        n, s = F.sum(F.when(kept, F.col("n")).otherwise(0)), exact_sum(F.when(kept, F.col("s")))
        out += [n.alias(name), F.when(n > 0, rounded(s / n, 2)).alias(f"{name}_avg")]
    return daily.groupBy(symbol).agg(*out)


# --- growth and totals over reporting periods -----------------------------------

def growth(periods: DataFrame, symbol: str, period: str, value: str) -> DataFrame:
    """Change against the period before, null where that period is missing.

    ``period`` is a running number of periods, one row each and symbol, so each
    window is as short as the calendar.
    """
    number = F.col(period).cast("bigint")
    before = F.sum(value).over(Window.partitionBy(symbol).orderBy(number).rangeBetween(-1, -1))
    return periods.withColumn("previous", before).withColumn(
        "growth_pct",
        F.when(F.col("previous") != 0, rounded((F.col(value) - F.col("previous")) / F.col("previous") * 100, 2)),
    )


def trailing_total(periods: DataFrame, symbol: str, period: str, value: str, n: int = 4) -> DataFrame:
    """Sum of the last ``n`` periods, only where all ``n`` are there.

    ``period`` is a running number of periods (of quarters: 4 * year + quarter),
    so a missing one leaves a gap and not a longer span.
    """
    frame = Window.partitionBy(symbol).orderBy(F.col(period).cast("bigint")).rangeBetween(1 - n, 0)
    return (
        periods.withColumn("ttm", rounded(F.sum(F.col(value).cast("decimal(28,6)")).over(frame), 2))
        .withColumn("_periods", F.count("*").over(frame))
        .where(F.col("_periods") == n).drop("_periods")
    )


def surprise(actual: Column, estimate: Column) -> Column:
    return F.when(estimate != 0, rounded((actual - estimate) / estimate * 100, 2))
