"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickerloom.llm import vectors as vec
from tickerloom.session import durable_table

EVERY, TOP = 20, 20
#: The tree is fitted on at most so many rows, the first by a hash of the id; every row is indexed.
SAMPLE = 8192
BRANCH, LEAF = 8, 16
#: Leaf visits are widened until this recall is reached on the sample, by so many of its rows as queries.
RECALL, PROBES = 0.96, 256


class KMeansTree:
    """Centres by node; a node's children are ``first[node]`` to ``first[node] + count[node]``, none for a leaf."""

    def __init__(self, rows: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        self.centre = [rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])]
        self.first, self.count = [0], [0]
        chance = np.random.Generator(np.random.PCG64(seed))
        members = {0: np.arange(len(rows))}
        todo = [0]
        while todo:
            node = todo.pop(0)
            own = members.pop(node)
            if len(own) <= branch * leaf // 2:
                continue
            label, centres = _kmeans(rows[own], branch, chance)
            groups = [own[label == j] for j in range(len(centres))]
            if max(map(len, groups)) == len(own):
                continue  # rows alike: one leaf
            self.first[node], self.count[node] = len(self.centre), len(centres)
            for centre, group in zip(centres, groups, strict=True):
                members[len(self.centre)] = group
                todo.append(len(self.centre))
                self.centre.append(centre)
                self.first.append(0)
                self.count.append(0)
        self.centre, self.first, self.count = np.array(self.centre), np.array(self.first), np.array(self.count)
        self.leaf = np.cumsum(self.count == 0) - 1  # number of each leaf among the leaves
        self.leaves = int((self.count == 0).sum())

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child, level by level."""
        at = np.zeros(len(rows), np.int64)
        while True:
            inner = np.unique(at[self.count[at] > 0])
            if not len(inner):
                return self.leaf[at]
            for node in inner:
                here = np.flatnonzero(at == node)
                child = self.centre[self.first[node] : self.first[node] + self.count[node]]
                distance = (child * child).sum(axis=1)[None, :] - 2 * rows[here] @ child.T
                at[here] = self.first[node] + distance.argmin(axis=1)

    def visits(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves in best-bin-first order: a priority queue by inner product with the centre."""
        near = self.centre @ query
        queue, order = [(-near[0], 0)], []
        while queue and len(order) < leaves:
            _, node = heapq.heappop(queue)
            if self.count[node] == 0:
                order.append(int(self.leaf[node]))
            for child in range(self.first[node], self.first[node] + self.count[node]):
                heapq.heappush(queue, (-near[child], child))
        return order

    def calibrated(self, rows: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES) -> int:
        """How many leaf visits reach ``recall`` of the true k best within the sample, on average over the probes."""
        if self.leaves == 1 or len(rows) <= k + 1:
            return self.leaves
        leaf_of = self.assign(rows)
        needed = []
        for i in np.linspace(0, len(rows) - 1, min(probes, len(rows))).astype(int):
            score = rows @ rows[i]
            score[i] = -np.inf
            place = np.empty(self.leaves, np.int64)
            place[self.visits(rows[i], self.leaves)] = np.arange(self.leaves)
            needed.append(place[leaf_of[np.argpartition(-score, k - 1)[:k]]])
        needed = np.sort(np.concatenate(needed))
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def _kmeans(rows: np.ndarray, branch: int, chance, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(rows, axis=0)
    centres = distinct[chance.choice(len(distinct), min(branch, len(distinct)), replace=False)]
    for _ in range(rounds):
        label = ((centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)
        used = np.unique(label)
        centres = np.array([rows[label == j].mean(axis=0) for j in used])
    label = ((centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)
    return label, centres


def _assigner(tree: KMeansTree, width: int):
    def assign(batches):
        for batch in batches:
            leaf = tree.assign(vec.matrix(batch["v"], width)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(leaf)], ["vec_id", "v", "leaf"])

    return assign


def _visitor(tree: KMeansTree, width: int, visits: int, edge: np.ndarray, size: int):
    """Sends each query to the tiles that hold a leaf it visits. ``edge``: first row number of each leaf, and the end; ``size``: rows of a tile."""

    def visit(batches):
        for batch in batches:
            asked = vec.matrix(batch["v"], width)
            rows, tiles, seen = [], [], []
            for i, query in enumerate(asked):
                leaves = np.array(tree.visits(query, visits), np.int64)
                leaves = np.sort(leaves[edge[leaves + 1] > edge[leaves]])
                of = [np.arange(edge[x] // size, (edge[x + 1] - 1) // size + 1) for x in leaves]
                tile = np.unique(np.concatenate(of)) if of else np.zeros(0, np.int64)
                rows += [i] * len(tile)
                tiles.append(tile)
                seen += [leaves.astype(np.int32).tobytes()] * len(tile)
            if rows:
                here = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [here["vec_id"], here["v"], here["q"], pa.array(np.concatenate(tiles).astype(np.int64)), pa.array(seen, pa.binary())],
                    ["vec_id", "v", "q", "tile", "leaves"],
                )

    return visit


def _search(k: int, leaves: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            width = vec.width_of(left["v"], right["v"])
            rows, asked = vec.matrix(left["v"], width), vec.matrix(right["v"], width)
            ids, query_ids, leaf = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), left["leaf"].to_numpy()
            for begin in range(0, len(asked), vec.STEP):
                part, part_ids = asked[begin : begin + vec.STEP], query_ids[begin : begin + vec.STEP]
                visited = np.zeros((len(part), leaves), bool)
                for i, seen in enumerate(right["leaves"].slice(begin, len(part)).to_pylist()):
                    visited[i, np.frombuffer(seen, np.int32)] = True
                score = part @ rows.T
                score[~visited[:, leaf] | (part_ids[:, None] == ids[None, :])] = -np.inf
                bar = np.partition(score, max(len(ids) - k, 0), axis=1)[:, max(len(ids) - k, 0)]
                near = np.isfinite(score) & (score >= (bar - 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0))))[:, None])
                i, j = np.nonzero(near)
                # products summed in the order of the components, so that equal vectors score alike wherever they lie
                exact = np.zeros(len(i))
                for d in range(width):
                    exact += part[i, d] * rows[j, d]
                order = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                out["query_id"].append(part_ids[i[keep]])
                out["vec_id"].append(ids[j[keep]])
                out["score"].append(exact[keep])
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.float64 if c == "score" else np.int64)) for c, x in out.items()})

    return search


def nearest(table: DataFrame, *, every: int = EVERY, k: int = TOP, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """The k rows found nearest to each query by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; every other row is
    indexed and a candidate. The tree is fitted on ``sample`` rows and sent to the
    tasks (at most sample / LEAF * 1.2 centres). A query visits leaves best bin
    first; the number of visits is the one that reached ``recall`` on the sample.
    Rows lie in tiles of bounded size in the order of their leaves: small leaves
    share a tile, a large leaf (a vector that many rows hold) has several.

    Rows without an id, or whose vector is null, empty, zero or holds a null or
    non-finite component, take no part. Shorter vectors count as filled up with
    zeros. Equal scores go by the smaller id. Rows with the query's own id are no
    candidates; of a query id that repeats, the smallest vector asks; a candidate
    row that repeats is returned as often as it stands. Empty table: empty
    result. Other columns play no part.
    """
    spark = table.sparkSession
    rows = vec.usable(table).where(F.exists("v", lambda x: x != 0))
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    width = vec.width_of(first["v"]) if first.num_rows else 0
    if not first.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = vec.matrix(first["v"], width)
    tree = KMeansTree(fitted)
    visits = tree.calibrated(fitted, k, recall)

    indexed = durable_table(rows.mapInArrow(_assigner(tree, width), "vec_id long, v array<float>, leaf int"))
    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, n in indexed.groupBy("leaf").count().collect():  # one row per leaf of the fitted tree
        sizes[leaf] = n
    edge = np.concatenate([[0], np.cumsum(sizes)])
    at = F.element_at(F.array(*[F.lit(int(x)) for x in edge[:-1]]), F.col("leaf") + 1)
    size = F.element_at(F.array(*[F.lit(int(x)) for x in sizes]), F.col("leaf") + 1)
    tile = F.floor((at + F.pmod(F.xxhash64("vec_id"), size)) / vec.BLOCK_ROWS)

    asked = vec.queries_of(indexed.select("vec_id", "v"), every)
    query_blocks = asked.agg(vec.blocks(F.count("*"), vec.BLOCK_QUERIES)).scalar()
    left = indexed.withColumn("tile", tile).withColumn("q", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    right = asked.withColumn("q", vec.slot(query_blocks)).mapInArrow(
        _visitor(tree, width, visits, edge, vec.BLOCK_ROWS), "vec_id long, v array<float>, q int, tile long, leaves binary"
    )
    found = left.groupBy("tile", "q").cogroup(right.groupBy("tile", "q")).applyInArrow(_search(k, tree.leaves), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
