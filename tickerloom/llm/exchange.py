"""Exchange of numpy arrays: many small values travel as a few packed rows, one per task piece and bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession


def bucket_count(spark: SparkSession, factor: int = 4) -> int:
    """Buckets for packed rows: a few times the session's shuffle partitions, which are set by the size of the input."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each 64-bit hash, by its high bits."""
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def cut(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, that bucket's values of every column) for each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for begin, end in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        yield int(bucket[begin]), [c[begin:end] for c in columns]


def joined(blobs, kind) -> np.ndarray:
    """The values of packed cells, one after the other; nulls hold none."""
    return np.frombuffer(b"".join(x for x in blobs if x), kind)
