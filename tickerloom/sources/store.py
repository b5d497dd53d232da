"""Partitioned tables that are written again and again: a key's rows replace those it had."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, types as T

from tickerloom.session import durable_table


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds a partition."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    return files.exists(folder) and any("=" in s.getPath().getName() for s in files.listStatus(folder))


def read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, empty if nothing is there yet. ``schema`` holds the partition columns, too."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).load(path).select(*schema.names)


def write(rows: DataFrame, path: str, partitions: Sequence[str], fmt: str = "parquet") -> None:
    """Overwrite the partitions that ``rows`` has; others stay. Rebalancing
    gathers small partitions into few files and splits a large one."""
    out = rows.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*partitions).format(fmt).save(path)


def replace(
    rows: DataFrame, path: str, partitions: Sequence[str], key: Sequence[str], fmt: str = "parquet",
    replaced: DataFrame | None = None,
) -> None:
    """Put ``rows`` in the table at ``path`` in place of what it has under the same ``key``, of which null is a value, too.

    Only the partitions concerned are read and written. ``replaced`` lists the
    keys to replace where these may stand in other partitions than those of
    ``rows``, or have no row any more. Running it again with the same rows
    changes nothing, so a run that broke off is run again as it was. The files of
    a partition are swapped when all new ones are written; a partition that loses
    its last row goes after that. One writer at a time.
    """
    spark = rows.sparkSession
    rows = durable_table(rows)  # read again below; a time of the run must not change meanwhile
    gone = rows.select(*key).distinct() if replaced is None else replaced.select(*key).distinct()
    kept = read(spark, path, rows.schema, fmt)
    concerned = rows.select(*partitions)
    if replaced is not None:
        concerned = concerned.union(kept.join(gone, list(key), "left_semi").select(*partitions))
    concerned = concerned.distinct()
    # the small side of partition values prunes the folders that are read
    kept = kept.join(concerned, list(partitions), "left_semi")
    there = gone.withColumnsRenamed({k: f"__{k}" for k in key})
    same = reduce(lambda a, b: a & b, [kept[k].eqNullSafe(there[f"__{k}"]) for k in key])
    kept = kept.join(there, same, "left_anti").select(*rows.columns)
    out = rows.unionByName(kept)
    if replaced is None:
        write(out, path, partitions, fmt)
        return
    concerned, out = durable_table(concerned), durable_table(out)
    write(out, path, partitions, fmt)
    for empty in concerned.join(out.select(*partitions).distinct(), list(partitions), "left_anti").collect():  # partition names of this run
        _drop(spark, path + "".join(f"/{p}={empty[p]}" for p in partitions))


def _drop(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
