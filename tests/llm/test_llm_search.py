import math

import numpy as np
import pytest

from tickerloom.llm import impact, tree

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, v string, q int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    chance = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(chance.normal(size=(700, 16)) / 4)]
    rows[41] = (41, rows[40][1])  # ties
    rows[42] = (42, rows[40][1])
    return rows


def brute(rows, k, value, score):
    rows = [(i, value(v)) for i, v in rows]
    out = []
    for q, a in rows:
        if q % 20 == 0:
            near = sorted((-score(a, b), i) for i, b in rows if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_impact_search_is_exact(spark, vectors):
    found = sorted(tuple(r) for r in impact.exact_top_k(table(spark, vectors)).collect())
    assert found == brute(vectors, 20, lambda v: [math.floor(64 * x) for x in v], lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))


def test_impact_search_stops_early_on_proof():
    chance = np.random.default_rng(1)
    rows = impact.impacts(chance.normal(size=(3000, 64)) / 8, 64)
    index = impact.ImpactIndex(rows, np.float32)
    asked = rows[:8]
    own = np.eye(8, 3000, dtype=bool)
    for i, open_ in enumerate(index.best(asked, own, 20)):
        exact = rows @ asked[i]
        exact[i] = -np.inf
        assert set(np.argsort(-exact)[:20]) <= set(open_)
        assert len(open_) < 1500


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_impact_search_of_large_and_signed_values(spark, scale):
    rows = [(i, [scale * (-1) ** i * i, float(i % 3)]) for i in range(60)]
    found = sorted(tuple(r) for r in impact.exact_top_k(table(spark, rows)).collect())
    assert found == brute(rows, 20, lambda v: [math.floor(64 * float(np.float32(x))) for x in v], lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))


def test_tree_search_recall_order_and_scores(spark, vectors):
    found = [tuple(r) for r in tree.nearest(table(spark, vectors)).collect()]
    exact = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = brute(vectors, 20, lambda v: v, exact)
    by = dict(vectors)
    best = {(q, i) for q, _, i, _ in want}
    assert len(found) == len(want)
    assert len(best & {(q, i) for q, _, i, _ in found}) >= 0.9 * len(best)
    for q in {q for q, *_ in found}:
        own = sorted((r, i, s) for p, r, i, s in found if p == q)
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        for _, i, s in own:
            assert s == pytest.approx(exact(by[q], by[i]), abs=1e-12)


def test_tree_holds_every_row(vectors):
    rows = np.array([v for _, v in vectors])
    fitted = tree.KMeansTree(rows, leaf=4)
    assert fitted.leaves > 20
    order = fitted.visits(rows[3], fitted.leaves)
    assert sorted(order) == list(range(fitted.leaves))
    alike = tree.KMeansTree(np.ones((500, 4)))
    assert alike.leaves == 1


BAD = [(1, None), (3, [None, 1.0]), (5, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0])]


@pytest.mark.parametrize("search", [impact.exact_top_k, tree.nearest])
def test_unusable_rows_take_no_part(spark, search):
    rows = [*BAD, (0, [1.0, 0.0]), (2, [1.0, 0.5]), (4, [1.0, 0.5]), (20, [0.5, 0.5])]
    found = sorted((r.query_id, r.rank, r.vec_id) for r in search(table(spark, rows)).collect())
    assert found == [(0, 1, 2), (0, 2, 4), (0, 3, 20), (20, 1, 2), (20, 2, 4), (20, 3, 0)]


def test_zero_and_empty_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, []), (3, [1.0])]
    assert [(r.vec_id, r.score) for r in impact.exact_top_k(table(spark, rows)).orderBy("rank").collect()] == [(3, 4096), (1, 0), (2, 0)]
    assert [(r.vec_id, r.score) for r in tree.nearest(table(spark, rows)).orderBy("rank").collect()] == [(3, 1.0)]


@pytest.mark.parametrize("search", [impact.exact_top_k, tree.nearest])
def test_repeated_rows_and_empty_table(spark, search):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])]
    assert [(r.query_id, r.rank, r.vec_id) for r in search(table(spark, rows)).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 1)]
    assert search(table(spark, [])).collect() == []


def test_large_leaf_spans_tiles(spark, monkeypatch):
    monkeypatch.setattr(tree.vec, "BLOCK_ROWS", 64)
    rows = [(i, [1.0, 0.5]) for i in range(500)]
    found = tree.nearest(table(spark, rows)).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 21))
