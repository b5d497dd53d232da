"""Vector tables: which rows take part, their matrices, and the pairing of query blocks with candidate blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a candidate block and queries of a query block; a pair of blocks is one group of a task.
BLOCK_ROWS, BLOCK_QUERIES = 16384, 4096
#: Queries handled at once inside a group, which bounds the score matrix.
STEP = 256


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector without null or non-finite components."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``; of repeated ids the smallest vector asks."""
    return vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def blocks(rows: Column, size: int) -> Column:
    """How many blocks ``rows`` rows make."""
    return F.greatest(F.ceil(rows / size), F.lit(1)).cast("int")


def slot(number: Column) -> Column:
    """A block number below ``number``, by the hash of the id."""
    return F.pmod(F.xxhash64("vec_id"), number).cast("int")


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), kind)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def width_of(*vectors: pa.ChunkedArray) -> int:
    return max((int(x.max()) for v in vectors if len(v) for x in [np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in v.chunks])]), default=0)
