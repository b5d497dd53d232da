"""Vector codes: one codebook for each part of the vectors, fitted by ball k-means on integers."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays
from tickerloom.llm import vectors as vec
from tickerloom.session import durable_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one ball that are compared at once, those of the innermost rings first.
RING_ROWS = 512

_STATE = "q array<int>, code binary, far array<long>, part int, entry int, total array<long>, radius long"


@dataclass(frozen=True)
class Codebooks:
    """``entries``: integers by part, entry and position."""

    entries: np.ndarray

    def digest(self) -> str:
        """Hex sha256 of all components, decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


@dataclass(frozen=True)
class Balls:
    """For each part and entry its neighbours, nearest first, with the squares of their distances; and which balls can't change."""

    near: list[list[np.ndarray]]
    squares: list[list[np.ndarray]]
    still: np.ndarray


def squares_between(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact: by doubles where these hold every sum, else by long integers."""
    size = max((int(np.abs(x).max()) for x in (left, right) if x.size), default=0)
    if 16 * left.shape[1] * size * size < 2**53:
        left, right = left.astype(np.float64), right.astype(np.float64)
    return ((left * left).sum(axis=1)[:, None] - 2 * (left @ right.T) + (right * right).sum(axis=1)[None, :]).astype(np.int64)


def balls_of(now: np.ndarray, before: np.ndarray, radius: np.ndarray) -> Balls:
    """Which entries can take a member of another's ball.

    ``radius``: squared distance of each ball's farthest member from the entry as it
    was ``before``. A member is at most that and the entry's own move away, and an
    entry farther than twice this from the ball's can't be as near to it.
    """
    near, squares, still = [], [], np.zeros(radius.shape, bool)
    for part in range(len(now)):
        between = squares_between(now[part], now[part])
        moved = ((now[part] - before[part]) ** 2).sum(axis=1)
        reach = (np.sqrt(radius[part].astype(float)) + np.sqrt(moved.astype(float))) * (1 + 1e-9)
        np.fill_diagonal(between, -1)
        near.append([])
        squares.append([])
        for entry, own in enumerate(between):
            found = np.flatnonzero((own >= 0) & (own <= 4 * reach[entry] ** 2 + 1))
            found = found[np.argsort(own[found], kind="stable")]
            near[-1].append(found)
            squares[-1].append(own[found])
            still[part, entry] = moved[entry] == 0 and not moved[found].any()
    return Balls(near, squares, still)


def nearest_entry(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and its squared distance: every entry is compared."""
    far = squares_between(x, book)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(x)), code]


def moved_entry(x: np.ndarray, code: np.ndarray, far: np.ndarray, book: np.ndarray, balls: Balls, part: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Like ``nearest_entry`` for rows whose last code is known, with the number of distances worked out.

    A ball that can't change keeps its members and their distances. In any other
    a member at distance d from its entry is compared with the ring of neighbours
    at most 2d from that entry; those nearer than half the nearest neighbour are
    the ball's core and compared with none.
    """
    code, far, work = code.copy(), far.copy(), 0
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(len(book) + 1))
    for entry in range(len(book)):
        own = order[edges[entry] : edges[entry + 1]]
        if not len(own) or balls.still[part, entry]:
            continue
        here = squares_between(x[own], book[entry : entry + 1])[:, 0]
        far[own] = here
        work += len(own)
        ring = np.searchsorted(balls.squares[part][entry], 4 * here, "right")
        rows = np.argsort(ring, kind="stable")
        rows = rows[np.searchsorted(ring[rows], 1) :]
        for begin in range(0, len(rows), RING_ROWS):
            some = rows[begin : begin + RING_ROWS]
            others = balls.near[part][entry][: ring[some[-1]]]
            there = squares_between(x[own[some]], book[others])
            work += there.size
            there[np.arange(len(others))[None, :] >= ring[some][:, None]] = np.iinfo(np.int64).max
            least = there.min(axis=1)
            first = np.where(there == least[:, None], others[None, :], len(book)).min(axis=1)
            better = (least < here[some]) | (least == here[some]) & (first < entry)
            code[own[some[better]]], far[own[some[better]]] = first[better], least[better]
    return code, far, work


class _Sums:
    """Of one task: sum and number of the parts that each entry has, and the squared radius of its ball."""

    def __init__(self, books: np.ndarray):
        parts, entries, width = books.shape
        self.total = np.zeros((parts, entries, width + 1), np.int64)
        self.radius = np.zeros((parts, entries), np.int64)

    def add(self, part: int, x: np.ndarray, code: np.ndarray, far: np.ndarray) -> None:
        order = np.argsort(code, kind="stable")
        used, first = np.unique(code[order], return_index=True)
        self.total[part, used, :-1] += np.add.reduceat(x[order], first, axis=0)
        self.total[part, used, -1] += np.diff(np.append(first, len(code)))
        self.radius[part, used] = np.maximum(self.radius[part, used], np.maximum.reduceat(far[order], first))

    def rows(self, row_type: pa.DataType, vector_type: pa.DataType) -> pa.RecordBatch | None:
        part, entry = np.nonzero(self.total[:, :, -1])
        if not len(part):
            return None
        none = lambda kind: pa.nulls(len(part), kind)
        total = self.total[part, entry]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.reshape(-1)))
        return pa.RecordBatch.from_arrays(
            [none(row_type), none(vector_type), none(pa.binary()), none(pa.list_(pa.int64())), pa.array(part.astype(np.int32)),
             pa.array(entry.astype(np.int32)), lists, pa.array(self.radius[part, entry])],
            ["row", "q", "code", "far", "part", "entry", "total", "radius"],
        )


def _assigner(books: np.ndarray, balls: Balls | None):
    """Rows with their nearest entries, then the task's sums by part and entry as rows of their own."""
    parts, _, width = books.shape

    def assign(batches):
        sums, kinds = _Sums(books), None
        for batch in batches:
            n, kinds = batch.num_rows, (batch["row"].type, batch["q"].type)
            if not n:
                continue
            x = vec.matrix(batch["q"], parts * width, np.int64)
            code, far = np.empty((n, parts), np.uint8), np.empty((n, parts), np.int64)
            if balls:
                last = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(n, parts)
                was = batch["far"].flatten().to_numpy().reshape(n, parts)
            for part in range(parts):
                own = x[:, part * width : (part + 1) * width]
                if balls:
                    found = moved_entry(own, last[:, part].astype(np.int64), was[:, part], books[part], balls, part)[:2]
                else:
                    found = nearest_entry(own, books[part])
                code[:, part], far[:, part] = found
                sums.add(part, own, *found)
            edges = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
            codes = pa.Array.from_buffers(pa.binary(), n, [None, edges.buffers()[1], pa.py_buffer(code.tobytes())])
            none = lambda kind: pa.nulls(n, kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["q"], codes, pa.ListArray.from_arrays(edges, pa.array(far.reshape(-1))), none(pa.int32()), none(pa.int32()),
                 none(pa.list_(pa.int64())), none(pa.int64())],
                ["row", "q", "code", "far", "part", "entry", "total", "radius"],
            )
        if kinds and (rest := sums.rows(*kinds)):
            yield rest

    return assign


def _updated(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry's mean of its parts, floored, or the entry itself if none is its; and the squared radii."""
    by = state.where("part IS NOT NULL").select("part", "entry", "radius", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at")
    found = by.agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.max("radius").alias("radius")).collect()  # as many rows as the codebooks have components
    width = books.shape[2]
    number = {(r.part, r.entry): int(r.x) for r in found if r.at == width}
    now, radius = books.copy(), np.zeros(books.shape[:2], np.int64)
    for r in found:
        radius[r.part, r.entry] = r.radius
        if r.at < width:
            now[r.part, r.entry, r.at] = int(r.x) // number[r.part, r.entry]
    return now, radius


def integers(table: DataFrame, vector: str, scale: int, limit: int) -> DataFrame:
    """Rows whose vector is there and holds finite components only, with ``q``: floor(scale * x), at most ``limit`` in size."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(scale * x.cast("double")))).cast("int")
    return table.where(usable).withColumn("q", F.transform(v, whole))


def compress(
    table: DataFrame, *, id: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """The columns ``keep`` (default: all but the vector) with ``code`` and ``error`` of every usable row, and the codebooks.

    A component x counts as floor(scale * x). Vectors are cut into ``parts`` equal
    parts; a part's codebook starts as that part of the ``entries`` (256 at most)
    rows with the smallest ids. Each round every part goes to its nearest entry,
    ties to the lower index, and every entry becomes the floored mean of its parts;
    then all are assigned once more. ``code``: two hex digits for each part;
    ``error``: squared distances summed over the parts.

    Every row is in every sum. A round reads the last round's rows with their codes
    and distances, so balls without change cost nothing and others only their
    rings; it writes them with at most parts x entries rows of sums for each task.
    The driver holds the codebooks and those sums, added up.

    Rows whose vector is null or holds a null or non-finite component are dropped.
    Null ids come after all others; equal ids start the codebook in the order of
    their vectors, and repeated rows are coded alike. Shorter vectors, and a width
    that ``parts`` doesn't divide, count as filled up with zeros. An empty vector is
    all zeros. Components whose square could leave a long integer count as the
    largest that can't (2**27 for parts of 16). Empty table: empty result and
    codebooks. Other columns may have any name.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code digit pair tells at most 256 entries apart")
    spark = table.sparkSession
    arrays.bounded_batches(spark)
    names = [c for c in (keep or table.columns) if c not in ((vector,) if keep is None else ()) and c not in ("code", "error")]
    bare = table.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id}`").alias("i"), F.col(f"`{vector}`").alias("v"))
    widest = bare.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-max(widest or 0, 1) // parts))
    limit = min(2**30, 2 ** ((58 - (width - 1).bit_length()) // 2))
    rows = integers(bare, "v", scale, limit)
    first = rows.orderBy(F.col("i").asc_nulls_last(), "q").select("q").limit(entries).toArrow()
    row_type = rows.schema["row"].dataType.simpleString()
    result = [*[f"row.`{c}`" for c in names], "lower(hex(code)) AS code", "aggregate(far, 0L, (a, x) -> a + x) AS error"]
    if not first.num_rows:
        return rows.select("row", F.lit(b"").alias("code"), F.array().cast("array<long>").alias("far")).selectExpr(*result), Codebooks(np.zeros((parts, 0, width), np.int64))
    books = vec.matrix(first["q"], parts * width, np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    state, balls = rows.select("row", "q"), None
    for _ in range(rounds):
        state = durable_table(state.mapInArrow(_assigner(books, balls), f"row {row_type}, {_STATE}"))
        now, radius = _updated(state, books)
        books, balls = now, balls_of(now, books, radius)
        state = state.where("part IS NULL").select("row", "q", "code", "far")
    state = state.mapInArrow(_assigner(books, balls), f"row {row_type}, {_STATE}").where("part IS NULL")
    return state.selectExpr(*result), Codebooks(books)


def op13_codes(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded, books = compress(table, keep=["vec_id", "label"])
    coded = durable_table(coded)
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(errors, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [
        """v AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id) AS rn
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
)""",
        """x AS MATERIALIZED (
  SELECT rn, part, q[part * (len(q) // 4) + 1 : (part + 1) * (len(q) // 4)] AS x FROM v CROSS JOIN (SELECT unnest(range(4)) AS part)
)""",
        "b0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x AS c FROM x WHERE rn <= 256)",
    ]
    for r in range(5):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rn, part, best % 256 AS entry, best // 256 AS far
  FROM (SELECT rn, part, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) * 256 + entry) AS best
        FROM x JOIN b{r} USING (part) GROUP BY rn, part)
)""")
        if r < 4:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, b{r}.c) AS c
  FROM b{r} LEFT JOIN (
    SELECT part, entry, list(y ORDER BY i) AS c
    FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS y
          FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM x JOIN a{r} USING (rn, part)) GROUP BY part, entry, i)
    GROUP BY part, entry
  ) m USING (part, entry)
)""")
    return (
        "WITH " + ",\n".join(steps) + """,
done AS (SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a4 GROUP BY rn),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS s FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM v JOIN done USING (rn) CROSS JOIN books
"""
    )


SQL = _sql()
