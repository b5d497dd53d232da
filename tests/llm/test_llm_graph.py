import duckdb
import numpy as np
import pytest

from tickerloom.llm import graph

SCHEMA = "vec_id long, embedding array<float>, n long, node string, shard int, w int, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 5, "x", 1, 2, 0) for i, v in rows], SCHEMA)


def listed(x):
    return [float(y) for y in np.float32(x)]


def brute(rows, threshold=0.95):
    """All pairs in double precision."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    width = max([len(rows[k][1]) for k in good], default=1)
    full = {k: np.array(rows[k][1] + [0.0] * (width - len(rows[k][1])), np.float64) for k in good}
    for x, k in enumerate(good):
        for m in good[x + 1 :]:
            if full[k] @ full[m] / (np.linalg.norm(full[k]) * np.linalg.norm(full[m])) >= threshold:
                links[k] += 1
                links[m] += 1
                root[top(k)] = top(m)
    out = []
    for k, (i, _) in enumerate(rows):
        component = min((rows[m][0] for m in good if top(m) == top(k)), default=i) if k in good else i
        out.append((i, links[k], component, i == component))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clustered(chance, groups, size, width, noise):
    centres = chance.normal(size=(groups, width))
    return centres[chance.integers(0, groups, size)] + chance.normal(size=(size, width)) * noise


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(graph, "SHARD_ROWS", 60)


@pytest.mark.parametrize("noise", [0.04, 0.1, 0.25])
def test_links_equal_all_pairs(spark, small_shards, noise):
    chance = np.random.default_rng(1)
    rows = [(i, listed(v)) for i, v in enumerate(np.concatenate([clustered(chance, 40, 500, 32, noise), chance.normal(size=(300, 32))]))]
    want = brute(rows)
    assert sum(w[1] > 0 for w in want) > 250
    got = found(graph.near_duplicates(table(spark, rows)))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    if noise == 0.04:
        assert got == want


def test_tiles_of_one_shard_meet(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE_ROWS", 50)
    chance = np.random.default_rng(2)
    rows = [(i, listed(v)) for i, v in enumerate(clustered(chance, 3, 330, 16, 0.05))]
    assert found(graph.near_duplicates(table(spark, rows))) == brute(rows)


def test_margin_widens_until_the_audit_holds(spark, small_shards, monkeypatch):
    chance = np.random.default_rng(3)
    x = chance.normal(size=(150, 24))
    rows = [(i, listed(v)) for i, v in enumerate(np.concatenate([x, x + chance.normal(size=x.shape) * 0.3]))]
    margins = []
    plain = graph.found_links
    monkeypatch.setattr(graph, "found_links", lambda classes, count, width, threshold, margin: margins.append(margin) or plain(classes, count, width, threshold, margin))
    got = found(graph.near_duplicates(table(spark, rows), margin=0.0, recall=1.0))
    assert len(margins) > 1 or got == brute(rows)


BAD = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]


def test_odd_rows(spark):
    rows = [*BAD, (9, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1e-30, 0.0]), (20, [1.0]), (21, [-1.0, 0.0]), (7, [0.0, 1.0]), (30, [0.0, 3e38])]
    assert found(graph.near_duplicates(table(spark, rows))) == brute(rows)
    nameless = found(graph.near_duplicates(table(spark, [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0])])))
    assert nameless == [(3, 0, 3, True), (None, 0, None, True), (None, 0, None, True)]
    assert found(graph.near_duplicates(table(spark, BAD))) == [(i, 0, i, True) for i, _ in BAD]
    assert graph.near_duplicates(table(spark, [])).collect() == []


def test_threshold_is_met_exactly(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.6000000238418579, 0.7999]), (4, [4.0, 3.0])]
    assert found(graph.near_duplicates(table(spark, rows), threshold=0.6)) == brute(rows, 0.6)


def test_many_equal_vectors(spark):
    chance = np.random.default_rng(6)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(700)] + [(700 + i, listed(v)) for i, v in enumerate(chance.normal(size=(300, 3)))]
    assert found(graph.near_duplicates(table(spark, rows))) == brute(rows)


def test_graph_reaches_every_row_and_keeps_few_edges():
    chance = np.random.default_rng(7)
    rows = graph.unit(np.concatenate([clustered(chance, 5, 400, 16, 0.02), chance.normal(size=(400, 16))]))
    a, b = graph.robust_pruned(rows)
    assert len(a) < 2.2 * graph.DEGREE * len(rows)
    seen, todo = np.zeros(len(rows), bool), graph.medoids(rows)
    while len(todo):
        seen[todo] = True
        todo = np.unique(b[np.isin(a, todo)])
        todo = todo[~seen[todo]]
    assert seen.all()
    near = graph.TileGraph(rows, a, b).within(rows[:300], 0.95)
    exact = rows[:300] @ rows.T >= 0.95
    assert (near & exact).sum() >= 0.999 * exact.sum()


def test_query_on_a_table_with_links_equals_sql(spark, tmp_path):
    chance = np.random.default_rng(8)
    rows = [(i * 3, listed(v)) for i, v in enumerate(np.concatenate([clustered(chance, 30, 200, 16, 0.12), chance.normal(size=(100, 16))]))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(graph.SQL).fetchall(), key=repr)
    assert found(graph.op11_links(spark, str(tmp_path))) == want
    assert sum(not w[3] for w in want) > 50
