"""Row numbers, neighbours and medians that survive a hot key.

A window partitioned by symbol sorts all rows of that symbol in one task.
These operators sort the whole table by (key, order) across tasks instead,
so one symbol may span any number of tasks; what is left to combine is one
small row per (key, task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.operators.lookups import attach
from tickerloom.session import durable_table

ORDINAL = "_ordinal"
SEGMENT = "_segment"
# monotonically_increasing_id() holds the task number above this bit
TASK_BIT = 33

Order = Sequence[Column]


def lay_out(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """Sort globally and keep each row's place as a written value."""
    by = [*[F.col(k) for k in keys], *order]
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return durable_table(spread.withColumn(ORDINAL, F.monotonically_increasing_id())).withColumn(
        SEGMENT, F.shiftright(ORDINAL, TASK_BIT)
    )


def _earlier_segments(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: Sequence[str], order: Order, name: str, total: str | None = None) -> DataFrame:
    """1-based position of each row within its key; optionally the key's size.

    ``order`` must end in a unique column.
    """
    table = lay_out(df, keys, order)
    sizes = table.groupBy(*keys, SEGMENT).agg(F.count("*").alias("_rows"), F.min(ORDINAL).alias("_first"))
    before = F.coalesce(F.sum("_rows").over(_earlier_segments(keys)), F.lit(0))
    found = [*keys, SEGMENT, (before - F.col("_first") + 1).alias("_shift")]
    if total:
        found.append(F.sum("_rows").over(Window.partitionBy(*keys)).alias(total))
    numbered = attach(table, sizes.select(*found), [*keys, SEGMENT])
    return numbered.withColumn(name, F.col(ORDINAL) + F.col("_shift")).drop(ORDINAL, SEGMENT, "_shift")


def previous_value(df: DataFrame, keys: Sequence[str], order: Order, column: str, name: str) -> DataFrame:
    """``column`` of the row before, within the key; null for the first row."""
    table = lay_out(df, keys, order)
    within = Window.partitionBy(*keys, SEGMENT).orderBy(ORDINAL)
    last = table.groupBy(*keys, SEGMENT).agg(F.max_by(F.struct(column), ORDINAL).alias("_last"))
    carried = last.select(
        *keys, SEGMENT, F.lag("_last").over(Window.partitionBy(*keys).orderBy(SEGMENT)).alias("_carried")
    )
    near = table.withColumn("_near", F.lag(F.struct(column)).over(within))
    return (
        attach(near, carried, [*keys, SEGMENT])
        .withColumn(name, F.coalesce("_near", "_carried").getField(column))
        .drop(ORDINAL, SEGMENT, "_near", "_carried")
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, unique: str, name: str) -> DataFrame:
    """One row per key: the middle value, or the mean of the middle two."""
    numbered = number_rows(
        df.where(F.col(value).isNotNull()).select(*keys, value, unique),
        keys, [F.col(value), F.col(unique)], "_place", "_size",
    )
    middle = F.col("_place").between(F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1)
    return numbered.where(middle).groupBy(*keys).agg(F.avg(value).alias(name))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Order, n: int, name: str = "rec_no") -> DataFrame:
    """The first ``n`` rows per key.

    Spark cuts each task's input to ``n`` rows per key before the shuffle
    (window group limit), so a hot key costs n rows per task. It does so up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``; beyond, the table is sorted
    across tasks and numbered in its segments, so no task holds a whole key.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if 0 <= limit < n:
        return number_rows(df, keys, order, name).where(F.col(name) <= n).withColumn(name, F.col(name).cast("int"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= n)
