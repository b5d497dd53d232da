"""Lookups, existence joins and reports of what is missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of a table that holds one row per key.

    A plain join: adaptive execution sends a small table to all executors by
    its bytes, and splits a hot key where both sides shuffle. No job runs here.
    Null keys match each other.
    """
    renamed = per_key.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return rows.join(renamed, same, how).drop(*[f"__{k}" for k in keys])


def look_up(rows: DataFrame, names: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    """Left lookup of one column, with a default where the key is unknown.

    ``names`` carries no broadcast hint: a small dimension file is broadcast
    by Spark after a check of its size, a large one is joined by shuffle.
    """
    return rows.join(names.select(key, column), key, "left").withColumn(column, F.coalesce(column, default))


def with_shared(symbols: DataFrame, **shared: DataFrame) -> DataFrame:
    """Put market-wide datasets beside every symbol.

    Each dataset is one value, worked out once as a scalar subquery, so
    nothing is joined.
    """
    for name, one_value in shared.items():
        symbols = symbols.withColumn(name, one_value.scalar())
    return symbols


def availability(symbols: DataFrame, results: DataFrame, key: str, model: str, first: str, second: str) -> DataFrame:
    """Which of two models has a result for each symbol."""
    present = results.where(F.col(model).isin(first, second)).groupBy(key).agg(
        F.bool_or(F.col(model) == first).alias("has_first"),
        F.bool_or(F.col(model) == second).alias("has_second"),
    )
    has_first = F.coalesce("has_first", F.lit(False))
    has_second = F.coalesce("has_second", F.lit(False))
    return symbols.join(present, key, "left").select(
        *symbols.columns,
        F.when(has_first & has_second, F.lit(f"{first} · {second}"))
        .when(has_first, F.lit(first))
        .when(has_second, F.lit(second))
        .otherwise(F.lit(""))
        .alias("badge"),
    )


def to_do(symbols: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Symbols with no output yet.

    Finished keys are made distinct first: a symbol with very many results
    is one row in the join.
    """
    return symbols.join(done.select(key).distinct(), key, "left_anti")


def already_done(symbols: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return symbols.join(done.select(key).distinct(), key, "left_semi")


def missing_inputs(symbols: DataFrame, rows: DataFrame, key: str, valid: Column) -> DataFrame:
    """Expected symbols that will be skipped, and why."""
    seen = rows.groupBy(key).agg(F.bool_or(valid).alias("any_valid"))
    return (
        symbols.join(seen, key, "left")
        .where(~F.coalesce("any_valid", F.lit(False)))
        .select(
            *symbols.columns,
            F.when(F.col("any_valid").isNull(), F.lit("no input")).otherwise(F.lit("no valid rows")).alias("reason"),
        )
    )


def latest_paths(files: DataFrame, symbol: str, path: str, kinds: Mapping[str, Column]) -> DataFrame:
    """Per symbol the lexicographically last path of each kind, in one pass;
    null where a symbol has none."""
    return files.groupBy(symbol).agg(
        *[F.max(F.when(keep, F.col(path))).alias(name) for name, keep in kinds.items()]
    )
