"""Near-duplicate vectors: a robust-pruned flat graph, built in overlapping shards and searched from medoids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import vectors as vec
from tickerloom.llm.components import connected
from tickerloom.session import durable_table

THRESHOLD = 0.95
#: A shard holds about so many distinct vectors, a tile of it at most about so many; more centres than this are not made.
SHARD_ROWS, TILE_ROWS, CENTRES = 2048, 8192, 16384
#: A vector lies in the shards whose centre is at most so much less near, by cosine, than its nearest one.
MARGIN = 0.06
#: Vectors audited against all others, and the share of their links that must be found.
AUDITED, RECALL = 512, 0.995
#: Candidates and edges of a vector, and how much farther than through a neighbour an edge may go.
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.2
#: Places of the search's queue, those expanded at once, and how far below the threshold the range expands.
QUEUE, AT_ONCE, SLACK = 32, 4, 0.05
#: Vectors searched at once, and pairs of vectors compared at once.
STEP, PAIRS = 256, 1 << 16


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision, for finding; what is found is verified in double precision."""
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / np.where(scale == 0, 1, scale)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, summed in the order of the components."""
    dot, a, b = (np.zeros(len(left)) for _ in range(3))
    left, right = (x / np.abs(x).max(axis=1, keepdims=True) for x in (left, right))
    for d in range(left.shape[1]):
        dot += left[:, d] * right[:, d]
        a += left[:, d] * left[:, d]
        b += right[:, d] * right[:, d]
    return dot / (np.sqrt(a) * np.sqrt(b))


def spread(rows: np.ndarray, number: int, apart: float) -> np.ndarray:
    """Up to ``number`` of the rows, in their order, none nearer than ``apart`` to one before it."""
    taken: list[int] = []
    for begin in range(0, len(rows), STEP):
        block = rows[begin : begin + STEP]
        free = ~(block @ rows[taken].T >= apart).any(axis=1) if taken else np.ones(len(block), bool)
        near = block @ block.T >= apart
        for i in np.flatnonzero(free):
            if free[i]:
                taken.append(begin + int(i))
                free &= ~near[i]
        if len(taken) >= number:
            break
    return np.array(taken[:number], np.int64)


def medoids(rows: np.ndarray) -> np.ndarray:
    """Where searches start: the row nearest to the mean, then rows each farthest from those before."""
    mean = rows.mean(axis=0)
    taken = [int((rows @ mean).argmax())]
    near = rows @ rows[taken[0]]
    while len(taken) < min(len(rows), 4 + int(len(rows) ** 0.5 / 2)):
        taken.append(int(near.argmin()))
        np.maximum(near, rows @ rows[taken[-1]], out=near)
    return np.unique(taken)


def robust_pruned(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) among rows of length 1.

    Of a row's nearest others, nearest first, one becomes an edge unless an edge
    so far is ``ALPHA`` times nearer to it than the row itself. Edges go both ways;
    a row keeps its 2 * ``DEGREE`` nearest. Rows that no path from a medoid
    reaches are hung on the nearest row that one does.
    """
    n = len(rows)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(CANDIDATES, n - 1)
    froms, tos = [], []
    for begin in range(0, n, STEP):
        own = np.arange(begin, min(begin + STEP, n))
        score = rows[own] @ rows.T
        score[np.arange(len(own)), own] = -2
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        at = np.take_along_axis(score, near, axis=1)
        order = np.argsort(-at, axis=1, kind="stable")
        near, at = np.take_along_axis(near, order, axis=1), np.take_along_axis(at, order, axis=1)
        between = np.matmul(rows[near], rows[near].transpose(0, 2, 1))
        alive, number = np.ones(near.shape, bool), np.zeros(len(own), np.int64)
        kept = np.zeros(near.shape, bool)
        for j in range(k):
            kept[:, j] = alive[:, j] & (number < DEGREE)
            number += kept[:, j]
            # squared distances of unit rows: 2 - 2 * cosine
            alive &= ~(kept[:, j, None] & (ALPHA * ALPHA * (1 - between[:, j]) <= 1 - at))
        i, j = np.nonzero(kept)
        froms.append(own[i])
        tos.append(near[i, j])
    a, b = np.concatenate(froms), np.concatenate(tos)
    a, b = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0).T
    far = np.concatenate([1 - np.einsum("ij,ij->i", rows[a[s : s + PAIRS]], rows[b[s : s + PAIRS]]) for s in range(0, len(a), PAIRS)])
    order = np.lexsort((b, far, a))
    a, b = a[order], b[order]
    stay = np.arange(len(a)) - np.searchsorted(a, a) < 2 * DEGREE
    a, b = a[stay], b[stay]
    more = _adopted(rows, a, b)
    return np.concatenate([a, more[0]]), np.concatenate([b, more[1]])


def _adopted(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to rows that no path from a medoid reaches, each from the nearest row that one does."""
    edge = np.searchsorted(a, np.arange(len(rows) + 1))
    seen, todo = np.zeros(len(rows), bool), medoids(rows)
    froms, tos = [], []
    seen[todo] = True
    while True:
        while len(todo):
            found = np.unique(np.concatenate([b[edge[x] : edge[x + 1]] for x in todo]))
            todo = found[~seen[found]]
            seen[todo] = True
        lost = np.flatnonzero(~seen)[:STEP]
        if not len(lost):
            return (np.concatenate(froms), np.concatenate(tos)) if froms else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        known = np.flatnonzero(seen)
        froms.append(known[(rows[lost] @ rows[known].T).argmax(axis=1)])
        tos.append(lost)
        seen[lost] = True
        todo = lost


class TileGraph:
    """The rows of a tile with the edges between them as a table padded with -1."""

    def __init__(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        self.rows, self.starts = rows, medoids(rows)
        self.edges = np.full((len(rows), int(place.max(initial=0)) + 1), -1, np.int32)
        self.edges[a, place] = b

    def within(self, asked: np.ndarray, threshold: float) -> np.ndarray:
        """Which rows lie within the threshold, of those that the search from the medoids comes to: asked x rows."""
        q, n = len(asked), len(self.rows)
        seen, expanded, near = (np.zeros((q, n), bool) for _ in range(3))
        everyone = np.arange(q)[:, None]
        bar = threshold - SLACK

        score = asked @ self.rows[self.starts].T
        seen[:, self.starts] = True
        near[:, self.starts] = score >= bar
        size = min(QUEUE, n)
        queue, rank = np.full((q, size), -1, np.int64), np.full((q, size), -np.inf, np.float32)
        best = np.argsort(-score, axis=1, kind="stable")[:, :size]
        queue[:, : best.shape[1]], rank[:, : best.shape[1]] = self.starts[best], np.take_along_axis(score, best, axis=1)
        while True:
            open_ = (queue >= 0) & ~expanded[everyone, queue]
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                break
            open_ = open_[active]
            open_ &= np.cumsum(open_, axis=1) <= AT_ONCE
            i, j = np.nonzero(open_)
            nodes = queue[active[i], j]
            expanded[active[i], nodes] = True
            who, new, score = self._fresh(asked, seen, active[i], nodes)
            near[who, new] = score >= bar
            if not len(who):
                continue
            # the new rows of each query side by side, then the best of old and new
            order = np.argsort(who, kind="stable")
            who, new, score = who[order], new[order], score[order]
            some, first = np.unique(who, return_index=True)
            place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            width = int(place.max()) + 1
            at = np.searchsorted(some, who)
            ids, ranks = np.full((len(some), size + width), -1, np.int64), np.full((len(some), size + width), -np.inf, np.float32)
            ids[:, :size], ranks[:, :size] = queue[some], rank[some]
            ids[at, size + place], ranks[at, size + place] = new, score
            best = np.argsort(-ranks, axis=1, kind="stable")[:, :size]
            queue[some], rank[some] = np.take_along_axis(ids, best, axis=1), np.take_along_axis(ranks, best, axis=1)
        # the range: every row near the threshold is expanded, until no new one comes
        while len(todo := np.flatnonzero(near & ~expanded)):
            for begin in range(0, len(todo), PAIRS // 16):
                i, node = np.divmod(todo[begin : begin + PAIRS // 16], n)
                expanded[i, node] = True
                who, new, score = self._fresh(asked, seen, i, node)
                near[who, new] = score >= bar
        return near

    def _fresh(self, asked: np.ndarray, seen: np.ndarray, who: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours of the nodes that their queries haven't seen, with their cosines."""
        n = len(self.rows)
        to = self.edges[nodes]
        known = (to < 0) | seen[who[:, None], to]
        key = np.unique((who[:, None] * n + to)[~known])
        who, new = np.divmod(key, n)
        seen[who, new] = True
        score = np.empty(len(who), np.float32)
        for s in range(0, len(who), PAIRS):
            score[s : s + PAIRS] = np.einsum("ij,ij->i", asked[who[s : s + PAIRS]], self.rows[new[s : s + PAIRS]])
        return who, new, score


def _sharder(centres: np.ndarray, width: int, margin: float):
    """Rows with the shards whose centre is nearly as near as the nearest."""

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = unit(vec.matrix(batch["v"], width))
            i, shard = [], []
            for begin in range(0, len(rows), STEP):
                score = rows[begin : begin + STEP] @ centres.T
                a, b = np.nonzero(score >= score.max(axis=1, keepdims=True) - margin)
                i.append(a + begin)
                shard.append(b)
            count = np.bincount(np.concatenate(i), minlength=len(rows)) if i else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            shards = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(shard).astype(np.int32) if shard else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["v"], batch["n"], shards], ["node", "v", "n", "shards"])

    return assign


def _builder(width: int):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table["node"].to_numpy()
        a, b = robust_pruned(unit(vec.matrix(table["v"], width)))
        return pa.table({"node": node[a], "to": node[b]})

    return build


def _searcher(width: int, threshold: float):
    """Counts and stars of one pair of tiles: node, links (rows of the vectors it links with), classes (those vectors), root."""

    def search(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        base = table.filter(pc.equal(table["t"], table["b"])).sort_by("node")
        same = table["a"][0].as_py() == table["b"][0].as_py()
        asking = base if same else table.filter(pc.equal(table["t"], table["a"])).sort_by("node")
        node, other = base["node"].to_numpy(), asking["node"].to_numpy()
        exact = vec.matrix(base["v"], width)
        own = exact if same else vec.matrix(asking["v"], width)
        rows = unit(exact)
        asked = rows if same else unit(own)
        to = base["to"].combine_chunks()
        lengths = to.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = to.flatten().to_numpy()
        at = np.minimum(np.searchsorted(node, flat), len(node) - 1)
        inside = node[at] == flat
        graph = TileGraph(rows, np.repeat(np.arange(len(node)), lengths)[inside], at[inside])

        found = np.zeros((len(asked), (len(rows) + 7) // 8), np.uint8)
        for begin in range(0, len(asked), STEP):
            found[begin : begin + STEP] = np.packbits(graph.within(asked[begin : begin + STEP], threshold), axis=1)
        shards, others = (_padded(x["shards"]) for x in (base, asking))
        n, m = base["n"].to_numpy(), asking["n"].to_numpy()
        # rows of both sides in one numbering, for counts and components
        shift = 0 if same else len(asked)
        links, classes = np.zeros((2, shift + len(rows)), np.int64)
        root = np.arange(shift + len(rows))
        for begin in range(0, len(asked), STEP):
            near = np.unpackbits(found[begin : begin + STEP], axis=1, count=len(rows)).astype(bool)
            if same:  # found from either side; each pair once
                back = np.unpackbits(found[:, begin // 8 : (begin + STEP) // 8], axis=1)[:, : len(near)].astype(bool)
                near |= back.T
                near &= np.arange(len(rows))[None, :] > np.arange(begin, begin + len(near))[:, None]
            i, j = np.nonzero(near)
            i += begin
            for s in range(0, len(i), PAIRS):
                x, y = i[s : s + PAIRS], j[s : s + PAIRS]
                keep = cosines(own[x], exact[y]) >= threshold
                x, y = x[keep], y[keep]
                # a pair that lies in several shards counts in the first of them
                common = (others[x][:, :, None] == shards[y][:, None, :]) & (others[x] >= 0)[:, :, None]
                least = np.where(common.any(axis=2), others[x], np.iinfo(np.int32).max).min(axis=1)
                x, y = x[least == shard], y[least == shard]
                np.add.at(links, x, n[y])
                np.add.at(links, shift + y, m[x])
                np.add.at(classes, x, 1)
                np.add.at(classes, shift + y, 1)
                for k in np.unique(x):
                    group = np.unique(root[np.append(shift + y[x == k], k)])
                    if len(group) > 1:
                        root[np.isin(root, group)] = group[0]
        ids = node if same else np.concatenate([other, node])
        some = classes > 0
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        return pa.table({"node": ids[some], "links": links[some], "classes": classes[some], "root": least[root][some]})

    return search


def _padded(lists: pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lengths), max(int(lengths.max(initial=1)), 1)), -1, np.int32)
    where = np.repeat(np.arange(len(lengths)), lengths)
    out[where, np.arange(len(where)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _auditor(asked: np.ndarray, ids: np.ndarray, width: int, threshold: float):
    """The number of vectors that each audited one links with, by comparing it with all."""

    def audit(batches):
        total = np.zeros(len(ids), np.int64)
        own = unit(asked)
        for batch in batches:
            rows, node = vec.matrix(batch["v"], width), batch["node"].to_numpy()
            for begin in range(0, len(rows), STEP):
                i, j = np.nonzero(unit(rows[begin : begin + STEP]) @ own.T >= threshold - 1e-4)
                i += begin
                keep = node[i] != ids[j]
                i, j = i[keep], j[keep]
                for s in range(0, len(i), PAIRS):
                    a, b = i[s : s + PAIRS], j[s : s + PAIRS]
                    total += np.bincount(b[cosines(rows[a], asked[b]) >= threshold], minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "true"])

    return audit


def _tiles(shard: Column, sizes: dict[int, int]) -> Column:
    """How many tiles each shard has; only those with several are told apart."""
    many = {s: -(-n // TILE_ROWS) for s, n in sizes.items() if n > TILE_ROWS}
    if not many:
        return F.lit(1)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), shard), F.lit(1))


def found_links(classes: DataFrame, count: int, width: int, threshold: float, margin: float) -> DataFrame:
    """What the search of each pair of tiles found: node, links, classes, root."""
    spark = classes.sparkSession
    vector = classes.schema["v"].dataType.simpleString()
    number = max(1, min(CENTRES, -(-count // SHARD_ROWS)))
    sample = classes.orderBy(F.xxhash64("node"), "node").select("v").limit(2 * number).toArrow()
    centres = unit(vec.matrix(sample["v"], width))
    centres = centres[spread(centres, number, threshold)]
    spread_out = durable_table(classes.mapInArrow(_sharder(centres, width, margin), f"node long, v {vector}, n long, shards array<int>"))
    placed = spread_out.withColumn("shard", F.explode("shards"))
    sizes = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}  # one row per centre
    tiles = _tiles(F.col("shard"), sizes)
    groups = sum(-(-n // TILE_ROWS) for n in sizes.values())
    tiled = placed.withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    parts = min(groups, 10 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = tiled.select("shard", "t", "node", "v").repartition(parts, "shard", "t").groupBy("shard", "t").applyInArrow(_builder(width), "node long, to long")
    adjacent = edges.groupBy("node").agg(F.sort_array(F.collect_set("to")).alias("to"))  # at most 2 * DEGREE, and some adopted rows, per shard
    joined = tiled.join(adjacent, "node", "left")
    # a tile asks itself and the tiles after it
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least(x, F.col("t")).alias("a"), F.greatest(x, F.col("t")).alias("b"))))
    dealt = joined.withColumn("pair", pairs).select("shard", "pair.a", "pair.b", "t", "node", "v", "n", "shards", "to")
    keys = ["shard", "a", "b"]
    return dealt.repartition(parts, *keys).groupBy(*keys).applyInArrow(_searcher(width, threshold), "node long, links long, classes long, root long")


def near_duplicates(
    table: DataFrame, *, threshold: float = THRESHOLD, margin: float = MARGIN, recall: float = RECALL, audited: int = AUDITED
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vec_id`` and ``embedding``.

    Two rows link when the cosine of their vectors, in double precision, is at
    least ``threshold``. Equal vectors are one class, found by grouping. Classes
    lie in every shard whose centre (a class chosen by hash, none within the
    threshold of another) is nearly as near as the nearest one. Each tile of a
    shard gets a robust-pruned graph; a class's edges from all its shards are put
    together. Then each class of a tile is searched for there: best first from
    the medoids, after which everything near the threshold is expanded until
    nothing new comes. What is found is verified, so no pair below the threshold
    links. ``audited`` classes, chosen by hash, are compared with all others; if
    the search found less than ``recall`` of their links, ``margin`` is doubled (0.01 at least)
    and the search repeated, until at last all classes share all shards.

    Nothing holds more than two tiles; pairs never leave their task, only their
    counts and one star for each component do. A pair in several shards counts in
    the first. A shard of many tiles (more vectors around one centre than the
    centres can split) pairs its tiles.

    Rows whose vector is null, empty, zero or holds a null or non-finite component,
    and rows without an id, link with nothing: their component is their own id, and
    they are kept. Shorter vectors count as filled up with zeros. Of rows that
    repeat, each links with the others; all whose id is the component's are kept.
    Empty table: empty result. Other columns play no part.
    """
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    usable = vec.usable(table).where(F.exists("v", lambda x: x != 0))
    classes = durable_table(
        usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    )
    count, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if count:
        sample = classes.orderBy(F.xxhash64("node", F.lit(1)), "node").select("node", "v").limit(audited).toArrow()
        ids = sample["node"].to_numpy()
        counts = classes.select("node", "v").mapInArrow(_auditor(vec.matrix(sample["v"], width), ids, width, threshold), "node long, true long")
        true = dict(counts.groupBy("node").agg(F.sum("true")).collect())  # one row per audited class
        while True:
            found = durable_table(found_links(classes, count, width, threshold, margin))
            caught = dict(found.join(F.broadcast(table.sparkSession.createDataFrame([(i,) for i in true], "node long")), "node").groupBy("node").agg(F.sum("classes")).collect())
            if sum(caught.values()) >= recall * sum(true.values()) or margin > 2:
                break
            margin = max(2 * margin, 0.01)
        totals = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = connected(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
        of_class = classes.select("node", "v", "rep", "n").join(totals, "node", "left").join(roots, "node", "left")
        of_class = of_class.withColumn("root", F.coalesce("root", "node"))
        # the smallest id of each component; its members are classes
        least = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
        of_class = of_class.join(least, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        # an unusable row has no class
        vectors = vectors.withColumn("w", F.when(F.col("vec_id").isNotNull(), F.col("v"))).join(of_class.withColumnRenamed("v", "w"), "w", "left")
    else:
        vectors = vectors.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    component = F.coalesce("component_id", "vec_id")
    return vectors.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_links(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a), c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
