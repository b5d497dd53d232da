import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickerloom.llm import jaccard
from tickerloom.llm.components import connected
from tickerloom.llm.jaccard import CountTree, Likeness, deduplicated, forest, near_duplicates, signatures

SCHEMA = "doc_id long, text string, n string, key int, component_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, like):
    sets = [shingles(t, like.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and like.den * both >= like.num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return sorted(((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def edited(words, chance, n):
    words = list(words)
    for at in chance.choice(len(words), n, replace=False):
        words[at] = f"new{chance.integers(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    chance = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = [f"w{x}" for x in chance.integers(0, 4000, int(chance.integers(3, 200)))]
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        rows.append(words)
        for n in range(int(chance.integers(0, 4))):
            rows.append(edited(words, chance, min(len(words) // 30 + n, len(words))))
    base = [f"b{x}" for x in range(150)]
    rows += [edited(base, chance, int(n)) for n in chance.integers(0, 6, 80)]
    return [(1000 - i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("like", [Likeness(3, 90, 100), Likeness(5, 80, 100), Likeness(1, 50, 100)])
def test_components_are_those_of_all_pairs(spark, corpus, like):
    found = sorted((tuple(r) for r in near_duplicates(table(spark, corpus), like).collect()), key=str)
    assert found == brute(corpus, like)


def test_tiles_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 7)
    like = Likeness(3, 90, 100)
    found = sorted((tuple(r) for r in near_duplicates(table(spark, corpus), like).collect()), key=str)
    assert found == brute(corpus, like)


def test_edge_rows(spark):
    long = " ".join(f"l{i % 977}x{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (None, "a b c d"), (7, "A  b\nC d"), (6, "a b c d"), (6, "a b c d"), (9, "one"), (8, "ONE"), (2, long), (1, long + " end"), (None, "alone here we are"), (11, "É ß"), (12, "é ß")]
    like = Likeness(3, 90, 100)
    found = sorted((tuple(r) for r in near_duplicates(table(spark, rows), like).collect()), key=str)
    want = sorted([t for t in brute([r for r in rows if r[1] and r[1].strip()], like)] + [(5, 0, 5), (4, 0, 4), (3, 0, 3)], key=str)
    assert found == want


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).collect() == []
    assert deduplicated(table(spark, [])).collect() == []


def test_one_of_each_group_stays(spark, corpus):
    docs = table(spark, corpus)
    out = deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in brute(corpus, Likeness())})


def test_linked_sets_share_a_signature():
    chance = np.random.default_rng(8)
    for like in (Likeness(3, 90, 100), Likeness(5, 80, 100), Likeness(5, 50, 100)):
        for _ in range(300):
            n = int(chance.integers(2, 400))
            a = np.unique(chance.integers(0, 2**63, n).astype(np.uint64))
            out = int(chance.integers(0, max(n // 4, 1) + 1))
            b = np.unique(np.concatenate([a[out:], chance.integers(0, 2**63, int(chance.integers(0, max(n // 4, 1) + 1))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if like.linked(np.array(common), np.array(len(a) + len(b))) and len(np.setxor1d(a, b)):
                assert set(signatures(a, like)) & set(signatures(b, like))


@pytest.mark.parametrize("n", [1, 31, 33, 1100, 2500])
def test_tree_loses_no_pair_the_bound_allows(n):
    chance = np.random.default_rng(n)
    like = Likeness(3, 90, 100)
    base = chance.integers(0, 12, (max(n // 20, 1), jaccard.GROUPS))
    points = base[chance.integers(0, len(base), n)] + (chance.random((n, jaccard.GROUPS)) < 0.05)
    sizes = points.sum(axis=1)
    tree = CountTree(sizes, points, like)
    for i in range(0, n, max(n // 40, 1)):
        found = set(tree.order[tree.search(int(sizes[i]), points[i])])
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero(like.linked(bound, sizes + sizes[i]))
        assert set(want) <= found
        near = (10 * np.maximum(sizes, sizes[i]) * 9 // 10 <= 10 * np.minimum(sizes, sizes[i])) | True
        assert found <= set(np.flatnonzero(near))
    joined = Counter()
    for i, j in forest(sizes, points, like):
        joined[j] += 1
    assert all(v == 1 for v in joined.values())


def test_connected_components(spark):
    chance = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in chance.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    found = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_split_by_size_keeps_linked_sets_together(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 3)
    like = Likeness(5, 80, 100)
    sizes = list(range(1, 400))
    found = jaccard._by_size(spark.createDataFrame([(n, n, 7) for n in sizes], "key long, n int, block long"), like).collect()
    blocks = {}
    for r in found:
        blocks.setdefault(r.key, set()).add(r.block)
    for a in sizes:
        for b in range(a, 400):
            if like.den * a >= like.num * b:  # at best, the smaller set lies in the larger
                assert blocks[a] & blocks[b]


def kept(spark, rows):
    return sorted((tuple(r)[:2] for r in deduplicated(table(spark, rows)).collect()), key=str)


def test_one_row_of_each_group_stays_where_ids_repeat_or_are_null(spark):
    text = lambda i, end="": " ".join(f"t{i}x{k}" for k in range(30)) + end
    assert kept(spark, [(1, text(1))] * 5 + [(2, text(1, " z"))]) == [(1, text(1))]
    # an id with two texts: one of its own, one a copy of a smaller id's
    assert kept(spark, [(3, text(3)), (5, text(3, " z")), (5, text(5))]) == [(3, text(3)), (5, text(5))]
    # null ids: a copy of a row with an id, copies of each other, and one alone
    rows = [(7, text(7)), (None, text(7, " z")), (None, text(8, " z")), (None, text(8)), (None, text(8)), (None, text(9))]
    assert kept(spark, rows) == sorted([(7, text(7)), (None, text(8)), (None, text(9))], key=str)
    # one id, near copies: the first by text
    assert kept(spark, [(4, text(4, f" {c}")) for c in "dbca"]) == [(4, text(4, " a"))]
    # rows without words stay, also if they repeat
    bare = [(6, None), (6, None), (None, ""), (None, ""), (6, " \t")]
    assert kept(spark, bare) == sorted(bare, key=str)
    # alike in id and text, not in other columns
    other = table(spark, [(1, text(1))]).union(spark.createDataFrame([(1, text(1), "w", 2, None)], SCHEMA))
    assert len(deduplicated(other).collect()) == 1


def test_each_candidate_class_meets_one_text(spark, monkeypatch):
    tiled, met = jaccard._tiled, []
    monkeypatch.setattr(jaccard, "_tiled", lambda members, *a: (met.append(members), tiled(members, *a))[1])
    text = lambda i, end: " ".join(f"t{i}x{k}" for k in range(60)) + end
    rows = [(None if i % 2 else 7, text(i, end)) for i in range(20) for end in ("", " z", " z")]
    like = Likeness(3, 90, 100)
    found = sorted((tuple(r) for r in near_duplicates(table(spark, rows), like).collect()), key=str)
    assert found == brute(rows, like)
    assert met[-1].columns == ["block", "key", "text"] and met[-1].count() == 40


def test_pieces_that_begin_alike_spread_over_buckets():
    batch = jaccard.pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["same words here", "other words here"], "mark": [5, 6]})
    out = list(jaccard._describe(Likeness(), 64)(iter([batch] * 50)))
    assert len({r["bucket"] for b in out for r in b.to_pylist() if r["kind"] == 0}) > 20


@pytest.mark.parametrize("n", [0, 1, 40, 3000, 90_000])
def test_finer_points_fold_to_the_coarse_and_bound_the_overlap(n):
    chance = np.random.default_rng(n)
    one = np.unique(chance.integers(0, 2**63, n, np.uint64) * np.uint64(2))
    other = np.concatenate([one[n // 9 :], np.unique(chance.integers(0, 2**63, n // 9, np.uint64))])
    points = jaccard.unpacked_points([jaccard.packed_point(jaccard.counts(s, jaccard.FINE_GROUPS)) for s in (one, other)], jaccard.FINE_GROUPS)
    few = jaccard.coarse(points)
    assert (few == np.array([jaccard.counts(s) for s in (one, other)])).all()
    common = len(np.intersect1d(one, other))
    assert common <= np.minimum(*points).sum() <= np.minimum(*few).sum()


def test_only_texts_of_candidates_are_shuffled(spark, monkeypatch):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    near = words(0).rsplit(" ", 1)[0] + " other"
    docs = spark.createDataFrame([(i, words(i)) for i in range(150)] + [(150, near), (151, words(0)), (152, None)], "doc_id long, text string")
    met, listed = [], jaccard._listed
    monkeypatch.setattr(jaccard, "_listed", lambda *a: (met.append(listed(*a)), met[-1])[1])
    stays = sorted(r.doc_id for r in jaccard.deduplicated(docs).collect())
    assert stays == [*range(150), 152]
    assert sorted({r.doc_id for r in met[0].collect()} - {151}) == [0, 150]
    monkeypatch.setattr(jaccard, "LISTED", 1)
    assert sorted(r.doc_id for r in jaccard.deduplicated(docs).collect()) == stays
    assert met[1].count() == 153


def test_long_sets_with_nothing_in_common_are_no_candidates():
    chance, like = np.random.default_rng(3), Likeness(5, 80, 100)
    sets = [np.unique(chance.integers(0, 2**63, n, np.uint64) * np.uint64(2)) for n in (15_000, 15_100, 15_900, 16_300, 16_500, 17_000, 40_000)]
    sets += [np.concatenate([sets[0][:-900], sets[1][:900]]), np.concatenate([sets[3], sets[4][:200]])]
    n = np.array([len(s) for s in sets])
    groups = jaccard.fine_groups(n)
    assert len(set(groups.tolist())) > 2
    cells = [jaccard.packed_point(jaccard.counts(s, g)) for s, g in zip(sets, groups.tolist(), strict=True)]

    def found(rows):
        at = [i for _, i in rows]
        table = {"block": [b for b, _ in rows], "key": at, "n": n[at].astype(np.int32), "point": [cells[i] for i in at]}
        return sorted((r["a"], r["b"]) for r in jaccard._bounded(like, fine=True)(jaccard.pa.table(table)).to_pylist())

    assert groups[3] < groups[8]
    assert found([(7, i) for i in range(len(sets))]) == [(0, 7), (3, 8)]
    assert found([(1, 0), (1, 1), (2, 3), (2, 8), (3, 2), (3, 4)]) == [(3, 8)]


def test_only_rows_that_may_go_are_shuffled(spark, monkeypatch):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    docs = spark.createDataFrame([(i, words(i % 40)) for i in range(50)], "doc_id long, text string")
    thinned = lambda df: "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
    out = jaccard.deduplicated(docs)
    assert thinned(out) and sorted(r.doc_id for r in out.collect()) == list(range(40))
    monkeypatch.setattr(jaccard, "LISTED", 1)
    out = jaccard.deduplicated(docs)
    assert not thinned(out) and sorted(r.doc_id for r in out.collect()) == list(range(40))


def test_long_texts_that_share_a_signature_are_told_apart_by_its_points():
    chance, like = np.random.default_rng(5), Likeness(5, 80, 100)
    texts = [" ".join(f"w{x}" for x in chance.integers(0, 10**6, int(n))) for n in chance.integers(900, 1100, 70)]
    texts.append(texts[3].rsplit(" ", 9)[0])
    batch = jaccard.pa.RecordBatch.from_pydict({"doc_id": list(range(71)), "text": texts, "mark": list(range(71))})
    rows = [r for r in jaccard._unpack(jaccard.pa.Table.from_batches(list(jaccard._describe(like, 1)(iter([batch]))))).to_pylist() if r["kind"] == 0]
    key = {r["doc_id"]: r["key"] for r in rows}

    def found(ids):
        some = [r for r in rows if r["doc_id"] in ids]
        table = {"block": [7] * len(some), "key": [r["key"] for r in some], "n": [r["n"] for r in some], "point": [r["point"] for r in some]}
        table = jaccard.pa.table(table, schema=jaccard.pa.schema({"block": "int64", "key": "int64", "n": "int32", "point": "binary"}))
        return {(r["a"], r["b"]) for r in jaccard._bounded(like)(table).to_pylist()}

    both = {(min(key[3], key[70]), max(key[3], key[70]))}
    assert found(range(71)) == found([*range(20), 70]) == found([3, 70]) == both and not found([3, 4])


@pytest.mark.parametrize("n", [0, 1, 500, 5_000, 60_000])
def test_tight_points_come_back(n):
    own = np.unique(np.random.default_rng(n).integers(0, 2**63, n, np.uint64) * np.uint64(2))
    groups = int(jaccard.mid_groups(n))
    points = [jaccard.counts(own, groups), np.append(np.zeros(groups - 1, np.int64), len(own))]
    cells = [jaccard.tight_point(p) for p in points]
    assert (jaccard.untight_points(cells, np.array([len(own)] * 2), groups) == np.array(points)).all()
    assert len(cells[0]) <= groups
