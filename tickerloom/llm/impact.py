"""Exact top-k inner-product search over an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm import vectors as vec

EVERY, TOP, SCALE = 20, 20, 64
#: The search stops adding segments once this share of a block's rows, at most, can still be among a query's best.
OPEN_SHARE = 1 / 32


def impacts(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, in double precision."""
    return np.floor(scale * v.astype(np.float64))


class ImpactIndex:
    """Posting segments of a block: the entries (row, dimension) whose impact has the same number of bits.

    Segments are kept from the highest level to the lowest. The segments of one
    level over all dimensions form one matrix, so that a whole block of queries
    processes them in one product. ``rest`` holds, after each level, the length
    of the part of each row not yet processed.
    """

    def __init__(self, rows: np.ndarray, kind):
        level = np.frexp(np.abs(rows))[1] * (rows != 0)
        self.levels = [x for x in np.unique(level)[::-1] if x > 0]
        self.rows = rows
        self.segments = [np.where(level == x, rows, 0).astype(kind) for x in self.levels]
        square = rows * rows
        self.rest = [np.sqrt(np.where(level < x, square, 0).sum(axis=1)) for x in self.levels]

    def best(self, queries: np.ndarray, own: np.ndarray, k: int):
        """For each query (row number of ``queries``) the rows that can be among its k best, with exact scores.

        ``own`` marks the pairs that take no part. After a level a row's score
        lies within rest * |query| of its accumulator. A row is given up only
        when its upper bound is below the k-th best lower bound.
        """
        n = len(self.rows)
        kind = self.segments[0].dtype if self.segments else np.float64
        reach = np.sqrt((queries * queries).sum(axis=1))[:, None]
        score = np.zeros((len(queries), n), kind)
        if n <= k or not self.segments:
            return [np.flatnonzero(~own[i]) for i in range(len(queries))]
        asked = queries.astype(kind)
        found: list = []
        for segment, rest in zip(self.segments, self.rest, strict=True):
            score += asked @ segment.T
            slack = (reach * rest[None, :] * (1 + 1e-6)).astype(np.float32)
            if 2 * float(slack.mean()) > float(score.max() - score.mean()) and rest.any():
                continue
            low = score - slack
            low[own] = -np.inf
            bar = np.partition(low, n - k, axis=1)[:, n - k]
            open_ = (score + slack >= bar[:, None]) & ~own
            if not rest.any() or open_.sum() <= max(OPEN_SHARE * n, 4 * k) * len(queries):
                found = [np.flatnonzero(x) for x in open_]
                break
        return found


def _kind(queries: np.ndarray, rows: np.ndarray):
    """The narrowest float in which every sum of products is exact."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    return np.float32 if top < 2**24 else np.float64


def _search(scale: float, k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            width = vec.width_of(left["v"], right["v"])
            rows = impacts(vec.matrix(left["v"], width), scale)
            asked = impacts(vec.matrix(right["v"], width), scale)
            ids, query_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            index = ImpactIndex(rows, _kind(asked, rows))
            for begin in range(0, len(asked), vec.STEP):
                part, part_ids = asked[begin : begin + vec.STEP], query_ids[begin : begin + vec.STEP]
                own = part_ids[:, None] == ids[None, :]
                for i, open_ in enumerate(index.best(part, own, k)):
                    exact = rows[open_].astype(np.int64) @ part[i].astype(np.int64)
                    order = np.lexsort((ids[open_], -exact))[:k]
                    out["query_id"].append(np.full(len(order), part_ids[i]))
                    out["vec_id"].append(ids[open_][order])
                    out["score"].append(exact[order])
        return pa.table({c: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for c, x in out.items()})

    return search


def exact_top_k(table: DataFrame, *, every: int = EVERY, k: int = TOP, scale: float = SCALE) -> DataFrame:
    """The k best rows of each query by the inner product of floor(scale * x): query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; every other row is a
    candidate. Rows are dealt by the hash of their id into blocks of bounded
    size; each pair of a query block and a row block is one group, which returns
    its k best. So no task holds more than two blocks, however large the table.

    A row without an id, or whose vector is null or holds a null or non-finite
    component, takes no part. Shorter vectors count as filled up with zeros; an
    empty vector scores 0. Equal scores go by the smaller id. Of rows with the
    query's own id none is a candidate; of a query id that repeats, the smallest
    vector asks; a candidate row that repeats is returned as often as it stands.
    Empty table: empty result. Other columns play no part.
    """
    rows = vec.usable(table)
    asked = vec.queries_of(rows, every)
    row_blocks = rows.agg(vec.blocks(F.count("*"), vec.BLOCK_ROWS)).scalar()
    query_blocks = asked.agg(vec.blocks(F.count("*"), vec.BLOCK_QUERIES)).scalar()
    left = rows.withColumn("b", vec.slot(row_blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    right = asked.withColumn("q", vec.slot(query_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), row_blocks - 1)))
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(_search(scale, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 20
"""
