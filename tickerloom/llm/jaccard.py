"""Near-duplicate join on shingle sets: group counts as points of an R-tree, surviving pairs verified exactly."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays, exchange
from tickerloom.llm.components import connected, hang
from tickerloom.session import durable_table

#: The least groups of the count vectors that travel with every signature, and of those sent for candidates only, and points of an R-tree page.
GROUPS, FINE_GROUPS, PAGE = 32, 256, 32
#: Shingles a group holds on average, at most, in vectors of more groups than the least: with many, all large sets look alike.
FILL = 8
#: Bytes of points compared at once: what fits a core's cache, and needs no fresh pages, takes a tenth of the time.
AT_ONCE = 1 << 17
#: Sizes within this factor of each other share a number of parts.
BAND = 1.5
#: A signature that more sets of a piece hold than this goes on as plain rows, so that no bucket fills with it.
FEW = 8
#: Sets, and shingles, of a tile: a larger block is compared tile by tile.
TILE_SETS, TILE_SHINGLES = 6000, 4_000_000
#: Shingles of a tile whose sets go by their count vectors, which are several times shorter.
TILE_COUNTED = 4 * TILE_SHINGLES
#: Rows whose marks are sent to all tasks, four bytes each.
LISTED = 4_000_000


@dataclass(frozen=True)
class Likeness:
    """Two sets link when den * intersection >= num * union, over shingles of ``words`` words."""

    words: int = 5
    num: int = 80
    den: int = 100

    def most_apart(self, both: np.ndarray | int):
        """The largest symmetric difference of linked sets of ``both`` shingles in all."""
        return both * (self.den - self.num) // (self.den + self.num)

    def least_common(self, both: np.ndarray) -> np.ndarray:
        """The smallest intersection of linked sets of ``both`` shingles in all."""
        return -(-both * self.num // (self.den + self.num))

    def linked(self, common: np.ndarray, both: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (both - common)


def _place(k: int) -> np.uint64:
    """What is added to the hash of a shingle's k-th word."""
    return np.uint64(0x632BE59BD9B4E019 * int(k) % 2**64)


def shingle_sets(words: arrays.Words, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; a shorter text is one shingle, one without words none."""
    h = words.hashes()
    n = len(h)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams[: max(n - k, 0)] += arrays.mix(h[k:] + _place(k))
    grams = arrays.mix(grams)
    out = []
    for begin, end in zip(words.of[:-1], words.of[1:], strict=True):
        if end - begin >= size:
            out.append(np.unique(grams[begin : end - size + 1]))
        elif end > begin:
            whole = np.zeros(1, np.uint64)
            for k in range(begin, end):
                whole += arrays.mix(h[k : k + 1] + _place(k - begin))
            out.append(arrays.mix(whole + np.uint64(end - begin)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(own: np.ndarray) -> int:
    """A 63-bit name of a set, 0 for the empty one."""
    if not len(own):
        return 0
    return int(arrays.mix(own.sum(keepdims=True) + np.uint64(len(own)))[0] >> np.uint64(1)) or 1


def counts(own: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The point of a set: how many of its shingles fall into each group (a power of two)."""
    return np.bincount((own >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def packed_point(point: np.ndarray) -> bytes:
    """A point in one byte a group, or four where a count needs them."""
    return point.astype(np.uint8 if point.max(initial=0) < 256 else np.uint32).tobytes()


def fine_groups(n: np.ndarray) -> np.ndarray:
    """Groups of the finer point of sets of n shingles: a power of two, so many that none holds more than FILL on average."""
    full = np.maximum(np.asarray(n, np.int64) // FILL, FINE_GROUPS - 1)
    return np.int64(1) << np.frexp(full.astype(np.float64))[1].astype(np.int64)


def mid_groups(n: np.ndarray) -> np.ndarray:
    """Groups of the point that travels with the signatures of sets of n shingles: as for the finer one, but GROUPS at least."""
    full = np.maximum(np.asarray(n, np.int64) // FILL, GROUPS - 1)
    return np.int64(1) << np.frexp(full.astype(np.float64))[1].astype(np.int64)


def _least(n: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The count a half byte begins at, for points of n shingles: about a window's half below the average."""
    return np.maximum(n // groups - 7, 0)


def tight_point(point: np.ndarray) -> bytes:
    """A point in half a byte a group; counts outside its window of 16 follow as (group, count), four bytes each."""
    groups = len(point)
    low = int(_least(point.sum(), groups))
    half = np.clip(point - low, 0, 15).astype(np.uint8)
    odd = np.flatnonzero(half + low != point)
    return (half[::2] | half[1::2] << 4).tobytes() + np.stack([odd, point[odd]], axis=1).astype(np.uint32).tobytes()


def untight_points(cells: list[bytes], n: np.ndarray, groups: int) -> np.ndarray:
    """The points of ``groups`` groups of sets of n shingles."""
    size = groups // 2
    half = np.frombuffer(b"".join([c[:size] for c in cells]), np.uint8).reshape(-1, size)
    out = np.empty((len(cells), groups), np.int32)
    out[:, ::2], out[:, 1::2] = half & 15, half >> 4
    out += _least(n, groups).astype(np.int32)[:, None]
    odd = np.frombuffer(b"".join([c[size:] for c in cells]), np.uint32).reshape(-1, 2)
    out[np.repeat(np.arange(len(cells)), [(len(c) - size) // 8 for c in cells]), odd[:, 0]] = odd[:, 1]
    return out


def unpacked_points(cells: list[bytes], groups: int = GROUPS, own: np.ndarray | None = None) -> np.ndarray:
    """Points of ``groups`` groups from cells that have ``own`` groups each, which is as many or more."""
    own = np.full(len(cells), groups, np.int64) if own is None else own
    out = np.zeros((len(cells), groups), np.int32)
    for g in np.unique(own).tolist():
        for width, kind in ((g, np.uint8), (4 * g, np.uint32)):
            at = [i for i in np.flatnonzero(own == g).tolist() if len(cells[i]) == width]
            if at:
                out[at] = coarse(np.frombuffer(b"".join(cells[i] for i in at), kind).reshape(-1, g), groups)
    return out


def coarse(fine: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Points of fewer groups: neighbouring groups are counted together."""
    return fine.reshape(len(fine), groups, fine.shape[1] // groups).sum(axis=2)


def signatures(own: np.ndarray, like: Likeness) -> np.ndarray:
    """Names of parts of a set such that two linked sets share one.

    Shingles are dealt into parts by hash. Linked sets differ in at most H
    shingles, so of H + 1 + e parts at least 1 + e are the same in both. e is set
    so that few sets have more than e empty parts; those that do also give the
    names of their empty parts. Hence sets that link share the name of a part.
    The number of parts goes by the size band of the larger set, so a set near
    the top of its band gives names for the next band too.
    """
    n = len(own)
    if not n or not like.most_apart(2 * n + 2 * n * (like.den - like.num) // like.num):
        return np.zeros(0, np.uint64)  # so small that only equal sets link
    band = math.floor(math.log(n) / math.log(BAND) + 1e-9)
    spread = arrays.mix(own)
    low, high = (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), (spread >> np.uint64(32)).astype(np.float64)
    sparse = math.exp(-(like.den + like.num) / (2 * (like.den - like.num) * BAND))
    out = []
    for b in (band, band + 1):
        if b > band and n * like.den < like.num * BAND**b * (1 - 1e-9):
            break
        apart = int(like.most_apart(2 * math.ceil(BAND ** (b + 1))))
        spare = math.ceil(sparse * apart + 3 * math.sqrt(sparse * apart))
        parts = apart + 1 + spare
        part = ((own >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
        filled = np.bincount(part, minlength=parts)
        name = np.bincount(part, low, parts).astype(np.uint64) + (np.bincount(part, high, parts).astype(np.uint64) << np.uint64(32))
        name = arrays.mix(name + arrays.mix(np.arange(parts, dtype=np.uint64) + np.uint64(b << 40)))
        out.append(name if parts - np.count_nonzero(filled) > spare else name[filled > 0])
    return np.concatenate(out)


def narrow(points: np.ndarray) -> np.ndarray:
    """Points in one byte a group, if no count needs more."""
    return points.astype(np.uint8) if points.max(initial=0) < 256 else points.astype(np.int32)


def overlaps(points: np.ndarray, at: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Per place in ``at`` the sum of the smaller counts of its point and ``other`` (one point, or one a place), ``most`` at most."""
    kind = np.uint16 if most < 2**16 else np.int64
    step = max(AT_ONCE // (points.shape[1] * points.itemsize), 1)
    out = np.empty(len(at), np.int64)
    for a in range(0, len(at), step):
        some = slice(a, a + step)
        out[some] = np.minimum(points[at[some]], other if other.ndim == 1 else other[some]).sum(axis=1, dtype=kind)
    return out


class CountTree:
    """A bulk-loaded R-tree over count vectors: nodes keep the largest coordinates and the range of sizes below them.

    The overlap of two sets is at most the sum over groups of the smaller count;
    for a node, of the smaller of the query's count and the node's largest.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray, like: Likeness):
        # tiles by size, then by the first coordinates inside a tile
        slab = max(PAGE * PAGE, 1)
        order = np.argsort(sizes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) // slab
        self.order = np.lexsort((points[:, 1], points[:, 0], rank))
        self.sizes, self.points, self.like = sizes[self.order], narrow(points[self.order]), like
        self.levels = []
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > PAGE:
            at = np.arange(0, len(top), PAGE)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))
        self.alive = np.ones(len(sizes), bool)

    def _pass(self, size: int, point: np.ndarray, at: np.ndarray, top, low, high) -> np.ndarray:
        like = self.like
        near = (like.den * high[at] >= like.num * size) & (like.num * low[at] <= like.den * size)
        at = at[near]
        return at[overlaps(top, at, point, size) >= like.least_common(low[at] + size)]

    def search(self, size: int, point: np.ndarray) -> np.ndarray:
        """Living places whose bound lets them link with the given set."""
        at = None
        point = np.minimum(point, np.iinfo(self.points.dtype).max).astype(self.points.dtype)
        below = [len(self.points), *(len(level[0]) for level in self.levels)]
        for depth in range(len(self.levels) - 1, -1, -1):
            at = np.arange(below[depth + 1]) if at is None else at
            at = self._pass(size, point, at, *self.levels[depth])
            at = (at[:, None] * PAGE + np.arange(PAGE)).ravel()
            at = at[at < below[depth]]
        at = np.flatnonzero(self.alive) if at is None else at[self.alive[at]]
        return self._pass(size, point, at, self.points, self.sizes, self.sizes)


def forest(sizes: np.ndarray, points: np.ndarray, like: Likeness, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join all that is joined: breadth first, each set leaves the tree when it is first reached.

    With ``sets`` a pair links when its sets do; without, when the bound allows it.
    """
    tree = CountTree(sizes, points, like)
    edges = []
    for begin in range(len(sizes)):
        if not tree.alive[begin]:
            continue
        tree.alive[begin] = False
        queue = [begin]
        while queue:
            i = queue.pop()
            found = tree.search(int(tree.sizes[i]), tree.points[i])
            if sets is not None and len(found):
                own = sets[tree.order[i]]
                common = np.array([_common(own, sets[tree.order[j]]) for j in found])
                found = found[like.linked(common, len(own) + tree.sizes[found])]
            tree.alive[found] = False
            edges += [(int(tree.order[i]), int(tree.order[j])) for j in found]
            queue += found.tolist()
    return edges


def page_pairs(begin: np.ndarray, size: np.ndarray):
    """The pairs of places inside each block of at most a page, many blocks at a time."""
    for k in np.unique(size[(size > 1) & (size <= PAGE)]).tolist():
        i, j = np.triu_indices(k, 1)
        first = begin[size == k]
        for some in np.array_split(first, -(-len(first) * len(i) // 2**20)):
            yield (some[:, None] + i).ravel(), (some[:, None] + j).ravel()


def levels(n: np.ndarray, groups: np.ndarray, like: Likeness):
    """(g, places) for each number of groups: the sets that have it, and those with more that may link with one of these.

    So two sets that link meet at the level of the one with fewer groups.
    """
    if groups.min() == groups.max():
        yield int(groups[0]), np.arange(len(n))
        return
    for g in np.unique(groups).tolist():
        most = n[groups == g].max()
        yield g, np.flatnonzero((groups == g) | ((groups > g) & (n * like.num <= most * like.den)))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


#: Inside a bucket a signature goes by 40 bits; two that are alike in them only make a candidate more.
_BITS, _SHORT = np.uint64(40), np.uint64(2**40 - 1)


def _five(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(blobs: list) -> np.ndarray:
    short = exchange.joined(blobs, np.uint8).reshape(-1, 5)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :5] = short
    return out.view(np.uint64).ravel()


def _describe(like: Likeness, buckets: int):
    """Documents -> packed rows: their sizes, names and points; their signatures by bucket."""

    def describe(batches):
        task = TaskContext.get()
        turn = np.uint64(task.partitionId() if task else 0) << np.uint64(32)
        for piece, batch in enumerate(arrays.pieces(batches, "text")):
            sets = shingle_sets(arrays.Words(batch["text"], lower=True), like.words)
            keys = np.array([set_key(s) for s in sets], np.int64)
            sizes = np.array([len(s) for s in sets], np.int32)
            points = [packed_point(counts(s, g)) for s, g in zip(sets, fine_groups(sizes).tolist(), strict=True)]
            _, first = np.unique(keys, return_index=True)
            names = [signatures(sets[i], like) for i in first]
            sig = np.concatenate(names)
            key = np.repeat(keys[first], [len(x) for x in names])
            # a signature that many sets of this piece hold goes on as plain rows, spread over all buckets
            order = np.argsort(sig, kind="stable")
            sig, key = sig[order], key[order]
            edge = np.flatnonzero(np.diff(sig, prepend=sig[:1] + np.uint64(1)))
            held = np.diff(np.append(edge, len(sig)))
            hot = np.repeat(held > FEW, held)
            # documents go by the place of their piece, so that no text, however common, fills a bucket
            home = int(exchange.bucket_of(arrays.mix(np.array([turn + np.uint64(piece)])), buckets)[0])
            rows = [(home, 0, batch["doc_id"].cast(pa.int64()).to_pylist(), keys.tobytes(), sizes.tobytes(), None, batch["mark"].to_numpy(zero_copy_only=False).tobytes(), points)]
            bucket_of, sig = exchange.bucket_of(sig, buckets), sig & _SHORT
            for bucket, (s, k) in exchange.cut(bucket_of[~hot], sig[~hot], key[~hot]):
                own = np.argsort(k, kind="stable")
                names_of, times = np.unique(k, return_counts=True)
                rows.append((bucket, 1, None, _five(s[own]), names_of.tobytes(), times.astype(np.uint32).tobytes(), None, None))
            block = bucket_of[hot].astype(np.uint64) << _BITS | sig[hot]
            spread = exchange.bucket_of(arrays.mix(block + key[hot].view(np.uint64)), buckets)
            for bucket, (s, k) in exchange.cut(spread, block, key[hot]):
                rows.append((bucket, 2, None, s.tobytes(), k.tobytes(), None, None, None))
            marks = edge[held > FEW]
            for bucket, (s,) in exchange.cut(bucket_of[marks], sig[marks]):
                rows.append((bucket, 3, None, s.tobytes(), None, None, None, None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "kind", "doc_id", "x", "y", "z", "mark", "points"])

    return describe


_PACKED = "bucket int, kind int, doc_id array<long>, x binary, y binary, z binary, mark binary, points array<binary>"
_ROWS = "kind int, doc_id long, mark long, n int, key long, point binary, fine binary, a long, b long"


def _unpack(table: pa.Table) -> pa.Table:
    """A bucket -> rows of kind 0 (a document) and 1 (a set that holds a signature which others hold too)."""
    by = {k: table.filter(pa.compute.equal(table["kind"], k)) for k in range(4)}
    key = exchange.joined(by[0]["x"].to_pylist(), np.int64)
    n = exchange.joined(by[0]["y"].to_pylist(), np.int32)
    fine = pa.compute.list_flatten(by[0]["points"]).to_pylist()
    ids = pa.compute.list_flatten(by[0]["doc_id"]).combine_chunks()
    mark = exchange.joined(by[0]["mark"].to_pylist(), np.int64)
    sig = _from_five(by[1]["x"].to_pylist())
    held = np.repeat(exchange.joined(by[1]["y"].to_pylist(), np.int64), exchange.joined(by[1]["z"].to_pylist(), np.uint32))
    order = np.lexsort((held, sig))
    sig, held = sig[order], held[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (held[1:] != held[:-1])
    sig, held = sig[new], held[new]
    edge = np.flatnonzero(np.diff(sig, prepend=sig[:1] + np.uint64(1)))
    size = np.diff(np.append(edge, len(sig)))
    many = np.repeat((size > 1) | np.isin(sig[edge], exchange.joined(by[3]["x"].to_pylist(), np.uint64)), size)
    through = exchange.joined(by[2]["x"].to_pylist(), np.uint64), exchange.joined(by[2]["y"].to_pylist(), np.int64)
    # a block's name holds its bucket again
    a = np.concatenate([(np.uint64(table["bucket"][0].as_py()) << _BITS | sig[many]).view(np.int64), through[0].view(np.int64)])
    b = np.concatenate([held[many], through[1]])
    total = [len(key), len(a)]
    lead = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(sum(total) - len(x), t)])
    return pa.table({
        "kind": pa.array(np.repeat([0, 1], total).astype(np.int32)),
        "doc_id": pa.concat_arrays([ids, pa.nulls(total[1], pa.int64())]),
        "mark": lead(mark, pa.int64()),
        "n": lead(n, pa.int32()),
        "key": lead(key, pa.int64()),
        "point": lead(_mid_points(fine, n), pa.binary()),
        "fine": lead(fine, pa.binary()),
        "a": pa.concat_arrays([pa.nulls(total[0], pa.int64()), pa.array(a)]),
        "b": pa.concat_arrays([pa.nulls(total[0], pa.int64()), pa.array(b)]),
    })


def _mid_points(fine: list[bytes], n: np.ndarray) -> list[bytes]:
    """The points that travel with signatures, from the finer ones."""
    out: list[bytes] = [b""] * len(n)
    groups, own = mid_groups(n), fine_groups(n)
    for g in np.unique(groups).tolist():
        at = np.flatnonzero(groups == g)
        for some in np.array_split(at, -(-len(at) * g // 2**20)):
            for i, point in zip(some.tolist(), unpacked_points([fine[i] for i in some.tolist()], g, own[some]), strict=True):
                out[i] = tight_point(point)
    return out


def _blocks(values: np.ndarray):
    """(begin, end) of runs of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1
    return zip(np.concatenate([[0], edges]), np.append(edges, len(values)), strict=True)


def _pairs(found: list[tuple]) -> pa.Table:
    stars = hang(found)
    return pa.table({"a": pa.array([a for a, _ in stars], pa.int64()), "b": pa.array([b for _, b in stars], pa.int64())})


def _bounded(like: Likeness, fine: bool = False):
    """Blocks of sets with their points, those of signatures or finer -> links that the bound allows."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("key", "ascending")])
        block, key, n = (table[c].to_numpy() for c in ("block", "key", "n"))
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (key[1:] != key[:-1])
        block, key, n = block[new], key[new], n[new].astype(np.int64)
        if not len(block):
            return _pairs([])
        cells = table["point"].filter(pa.array(new))
        groups = fine_groups(n) if fine else mid_groups(n)
        points = _fine_of(cells.to_pylist(), groups) if fine else _mid_of(cells, key, n, groups)
        begin = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        size = np.diff(np.append(begin, len(block)))
        found: list[tuple] = []
        # most blocks hold a few sets, and a tree of one page is that page: many of these at once
        for i, j in page_pairs(begin, size):
            near = like.den * np.minimum(n[i], n[j]) >= like.num * np.maximum(n[i], n[j])
            i, j = i[near], j[near]
            less = np.minimum(groups[i], groups[j])
            for g in np.unique(less).tolist():
                at = np.flatnonzero(less == g)
                for some in np.array_split(at, -(-len(at) * g // AT_ONCE)):
                    a, b = i[some], j[some]
                    may = like.linked(np.minimum(points(a, g), points(b, g)).sum(axis=1, dtype=np.int64), n[a] + n[b])
                    found += zip(key[a[may]].tolist(), key[b[may]].tolist(), strict=True)
        for a, k in zip(begin[size > PAGE].tolist(), size[size > PAGE].tolist(), strict=True):
            for g, at in levels(n[a : a + k], groups[a : a + k], like):
                at = at + a
                found += [(int(key[at[i]]), int(key[at[j]])) for i, j in forest(n[at], points(at, g), like)]
        return _pairs(found)

    return search


def _fine_of(cells: list[bytes], groups: np.ndarray):
    """(places, g) -> their points of g groups, from the finer ones."""
    return lambda at, g: unpacked_points([cells[i] for i in at.tolist()], g, groups[at])


def _mid_of(cells: pa.ChunkedArray, key: np.ndarray, n: np.ndarray, groups: np.ndarray):
    """(places, g) -> their points of g groups, from those that travel with signatures; each set's is unpacked once."""
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    unpacked, place = {}, np.zeros(len(first), np.int64)
    for g in np.unique(groups[first]).tolist():
        own = np.flatnonzero(groups[first] == g)
        place[own] = np.arange(len(own))
        unpacked[g] = narrow(untight_points(cells.take(pa.array(first[own])).to_pylist(), n[first[own]], g))

    def points(at: np.ndarray, g: int) -> np.ndarray:
        row, own = place[which[at]], groups[at]
        if (own == g).all():
            return unpacked[g][row]
        out = np.empty((len(at), g), np.int32)
        for level in np.unique(own).tolist():
            out[own == level] = coarse(unpacked[level][row[own == level]], g)
        return out

    return points


def _verified(like: Likeness):
    """Blocks of candidates with their texts -> links."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("key", "ascending")]).combine_chunks()
        block, key = table["block"].to_numpy(), table["key"].to_numpy()
        found: list[tuple] = []
        for begin, end in _blocks(block) if len(block) else ():
            sets: list[np.ndarray] = []
            for piece in arrays.pieces(table.slice(begin, end - begin).to_batches(), "text"):
                sets += shingle_sets(arrays.Words(piece["text"], lower=True), like.words)
            own = {int(key[begin + i]): s for i, s in enumerate(sets) if set_key(s) == key[begin + i]}
            names, sets = list(own), list(own.values())
            if len(names) > 1:
                sizes = np.array([len(s) for s in sets], np.int64)
                for g, at in levels(sizes, fine_groups(sizes), like):
                    some = [sets[i] for i in at]
                    links = forest(sizes[at], np.array([counts(s, g) for s in some], np.int32), like, some)
                    found += [(names[at[i]], names[at[j]]) for i, j in links]
        return _pairs(found)

    return search


def _tiled(members: DataFrame, tiles: DataFrame, buckets: int) -> DataFrame:
    """Members of blocks, dealt to groups (g, t1, t2): small blocks share groups; a block of several tiles has one for each two tiles.

    ``tiles`` lists the blocks of more than one tile. It is written, so that Spark
    knows its size; by its definition it is thousands of times shorter than
    ``members``, which then need no shuffle for it.
    """
    large = durable_table(tiles.where("tiles > 1"))
    t = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return (
        members.join(large, "block", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("t", t)
        .withColumn("u", other)
        .withColumn("g", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("block"), F.lit(buckets))).otherwise(F.col("block")))
        .select("*", F.least("t", "u").alias("t1"), F.greatest("t", "u").alias("t2"))
    )


def _tiles_of(sets: DataFrame, shingles: int = TILE_SHINGLES) -> DataFrame:
    """Tiles of each block, by its number of sets and of shingles."""
    tiles = F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / shingles))
    return sets.groupBy("block").agg(tiles.cast("int").alias("tiles"))


def _listed(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``texts`` without most rows whose mark is not in ``chosen``, so that only candidates' texts are shuffled.

    By 31 bits of the mark, which are sent to all tasks; a list too long for that
    filters nothing. The join by mark that follows is exact in either case.
    """
    short = _short(chosen)
    return texts if short is None else texts.join(short, _low() == F.col("low"), "left_semi")


def _low():
    """31 bits of the mark."""
    return F.pmod(F.col("mark"), F.lit(2**31)).cast("int")


def _short(rows: DataFrame) -> DataFrame | None:
    """``low`` of the marks of ``rows``, to be sent to all tasks; None if the list is too long for that."""
    short = durable_table(rows.select(_low().alias("low")).distinct())
    return F.broadcast(short) if short.count() <= LISTED else None


def _by_size(sets: DataFrame, like: Likeness, shingles: int = TILE_SHINGLES) -> DataFrame:
    """Splits blocks of more than one tile by size: sets that link lie in the same step of size or in neighbouring ones, so each goes to two."""
    large = durable_table(_tiles_of(sets, shingles).where("tiles > 1").select("block", F.lit(True).alias("split")))
    step = F.floor(F.log("n") / math.log(like.den / like.num) + 1e-9)
    steps = F.when(F.col("split"), F.array(step, step + 1)).otherwise(F.array(F.lit(0).cast("long")))
    return (
        sets.join(large, "block", "left")
        .withColumn("step", F.explode(steps))
        .withColumn("block", F.when(F.col("split"), F.xxhash64("block", "step")).otherwise(F.col("block")))
        .drop("split", "step")
    )


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    A document's set holds its distinct shingles of lower-cased words; a shorter
    text is one shingle. component_id is the smallest doc_id reachable by links.

    Equal sets are one node. Sets meet only where they share the name of a part
    (see :func:`signatures`), which loses no link. Sets that share a name are
    searched in an R-tree of count vectors, so that a passage in very many
    documents makes few candidates by itself; what its bound lets through is
    joined into blocks, which vectors of more groups divide once more, and
    within a block the pairs that survive the bound are verified on the sets
    themselves, from the texts. Blocks beyond a tile are
    compared tile by tile, so no task holds more than two tiles.

    Null or empty text, or one without words: no shingles, linked with nothing,
    its own doc_id as component. Null doc_id: the row still links; a component
    takes its smallest non-null id, and is null if it has none. Rows that repeat
    link with each other and are each returned. Empty table: empty result. Other
    columns play no part. Sets are told apart by 63-bit hashes of 64-bit shingle
    hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _labelled(texts.withColumn("mark", F.xxhash64("doc_id", "text")), like)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _labelled(texts: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, mark, n, label and component_id of each row of ``texts`` (doc_id, text, mark): rows of one component, and no others, have one label; it is null without words.

    ``mark`` is a hash of the row that tells its text, too.
    """
    spark = texts.sparkSession
    arrays.bounded_batches(spark)
    buckets = exchange.bucket_count(spark)
    rows = durable_table(texts.mapInArrow(_describe(like, buckets), _PACKED).groupBy("bucket").applyInArrow(_unpack, _ROWS))
    own = rows.where("kind = 0").select("doc_id", "mark", "n", "key")
    classes = rows.where("kind = 0 AND n > 0").groupBy("key", "n", "point").agg(F.min("doc_id").alias("rep"), F.min("mark").alias("mark"))

    # sets that share a common signature
    held = rows.where("kind = 1").select(F.col("a").alias("block"), F.col("b").alias("key"))
    tiles = held.groupBy("block").agg(F.ceil(F.count("*") / TILE_SETS).cast("int").alias("tiles"))
    members = _tiled(held.join(classes.select("key", "n", "point"), "key"), tiles, buckets)
    bounded = members.groupBy("g", "t1", "t2").applyInArrow(_bounded(like), "a long, b long")
    loose = connected(bounded)

    # many groups tell apart what few let through: a passage that long documents share joins hardly any of them.
    # Written, as it is read three times below
    fine = rows.where("kind = 0 AND n > 0").select("key", "n", "fine").join(loose.select(F.col("node").alias("key"), F.col("root").alias("block")), "key")
    fine = _by_size(durable_table(fine.distinct()), like, TILE_COUNTED)
    members = _tiled(fine.withColumnRenamed("fine", "point"), _tiles_of(fine, TILE_COUNTED), buckets)
    candidates = connected(members.select("g", "t1", "t2", "block", "key", "n", "point").groupBy("g", "t1", "t2").applyInArrow(_bounded(like, fine=True), "a long, b long"))

    # their texts, in blocks of sets that may be joined
    chosen = candidates.select(F.col("node").alias("key"), F.col("root").alias("block")).join(classes.select("key", "mark", "n"), "key")
    chosen = _by_size(chosen, like)
    sizes = _tiles_of(chosen)
    # one row per class, told by its mark: ids may repeat or be null. Rows that repeat become one before the shuffle
    once = _listed(texts, chosen).groupBy("mark").agg(F.first("text").alias("text"))
    found = once.join(chosen.hint("shuffle_hash"), "mark").select("block", "key", "text")
    links = _tiled(found, sizes, buckets).select("g", "t1", "t2", "block", "key", "text").groupBy("g", "t1", "t2").applyInArrow(_verified(like), "a long, b long")
    joined = connected(links)

    label = classes.join(joined, classes["key"] == joined["node"], "left").select("key", "rep", F.coalesce("root", "key").alias("label"))
    smallest = label.groupBy("label").agg(F.min("rep").alias("component_id"))
    component = label.join(smallest, "label").select("key", "label", "component_id")
    full = own.where("n > 0").join(component, "key").select("doc_id", "mark", "n", "label", "component_id")
    bare = own.where("n = 0").select("doc_id", "mark", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return full.union(bare)


def _row_mark(docs: DataFrame):
    """A hash of all columns of a row; a map, which has no hash, goes by its JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def deduplicated(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The rows of ``docs``, one per component of near duplicates: the one with the smallest doc_id, of rows alike in id the first by text.

    Judged row by row: an id may repeat with other texts, or be null (after all
    ids). Of rows alike in id and text, too, one stays, also of rows that repeat.
    Rows without words stay. Rows are told apart by id and a 64-bit hash of all
    columns.
    """
    ident, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    texts = docs.select(ident.alias("doc_id"), text.alias("text"), _row_mark(docs).alias("mark"))
    found = _labelled(texts, like).where("n > 0").groupBy("label", "component_id", "doc_id", "mark").agg(F.count("*").alias("times"))
    found = durable_table(found)
    least = found.where("doc_id <=> component_id")
    heads = least.groupBy("label").agg(F.min("mark").alias("head"), F.count("*").alias("rows"))
    # several rows of a component have its id: the first by text
    alike = durable_table(least.join(heads.where("rows > 1").select("label"), "label").select("label", F.col("doc_id").alias("l_id"), F.col("mark").alias("l_mark")))
    if not alike.isEmpty():
        same = (F.col("mark") == F.col("l_mark")) & F.col("doc_id").eqNullSafe(F.col("l_id"))
        first = texts.join(alike, same).groupBy("label").agg(F.min(F.struct("text", "mark")).alias("first"))
        heads = heads.where("rows = 1").select("label", "head").union(first.select("label", "first.mark"))
    judged = found.join(heads.select("label", "head"), "label")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("head"))
    # written, so that Spark knows its size: a short list is sent to all tasks, a long one is joined by a shuffle
    listed = judged.select(F.col("doc_id").alias("v_id"), "mark", stays.alias("stays"), "times").where("NOT stays OR times > 1")
    listed = durable_table(listed.select("v_id", F.col("mark").alias("v_mark"), "stays").sortWithinPartitions("v_id"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("id"), _row_mark(docs).alias("mark"))
    there = (F.col("mark") == F.col("v_mark")) & F.col("id").eqNullSafe(F.col("v_id"))
    # only rows whose mark may be listed are shuffled; the others stay where they are
    short = _short(listed.select(F.col("v_mark").alias("mark")))
    asked = packed if short is None else packed.join(short, _low() == F.col("low"), "left_semi")
    out = asked.join(listed, there, "left_anti").select("row.*")
    again = durable_table(listed.where("stays"))
    if not again.isEmpty():
        out = out.union(asked.join(again, there).groupBy("id", "mark").agg(F.first("row").alias("row")).select("row.*"))
    return out if short is None else out.union(packed.join(short, _low() == F.col("low"), "left_anti").select("row.*"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Likeness(3, 90, 100))
