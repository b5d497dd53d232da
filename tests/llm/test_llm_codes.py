import hashlib
import math

import numpy as np
import pytest

from tickerloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, q int, part int, error string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, 2, "e") for i, v, label in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain integers, every entry compared."""
    rows = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    squares = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((squares(x, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(v[p], books[p])[1] for v in cut]
            for k in set(own):
                members = [v[p] for v, o in zip(cut, own, strict=True) if o == k]
                books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = []
    for v in cut:
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append(("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(out), digest


def coded(spark, rows, **more):
    found, books = codes.compress(table(spark, rows), keep=["vec_id", "label"], **more)
    return sorted((r.code, r.error) for r in found.collect()), books.digest()


@pytest.mark.parametrize("kind", ["normal", "coarse", "groups"])
def test_equals_plain_k_means(spark, kind):
    chance = np.random.default_rng(len(kind))
    rows = chance.normal(size=(420, 8)) / 4
    if kind == "coarse":  # many ties and equal entries
        rows = np.round(rows * 3) / 3
    if kind == "groups":
        rows[:300] = rows[chance.integers(0, 6, 300)] + chance.normal(size=(300, 8)) / 500
    rows = [(i * 7 % 420, [float(x) for x in v], 0) for i, v in enumerate(rows)]
    assert coded(spark, rows) == brute([r[:2] for r in rows])
    assert coded(spark, rows, entries=20, rounds=6) == brute([r[:2] for r in rows], entries=20, rounds=6)


def test_balls_save_work_and_change_nothing():
    chance = np.random.default_rng(4)
    centres = chance.integers(-4000, 4000, (40, 2))
    x = (centres[chance.integers(0, 40, 20_000)] + chance.normal(size=(20_000, 2)) * 40).astype(np.int64)
    before = np.unique(x, axis=0)[chance.choice(5000, 64, replace=False)][None]
    code, far = codes.nearest_entry(x, before[0])
    works = []
    for _ in range(40):
        sums = codes._Sums(before)
        sums.add(0, x, code, far)
        now = before.copy()
        used = sums.total[0, :, -1] > 0
        now[0, used] = sums.total[0, used, :-1] // sums.total[0, used, -1:]
        balls = codes.balls_of(now, before, sums.radius)
        code, far, work = codes.moved_entry(x, code, far, now[0], balls, 0)
        want = codes.nearest_entry(x, now[0])
        assert (code == want[0]).all() and (far == want[1]).all()
        works.append(work)
        before = now
    assert works[0] < 0.5 * len(x) * 64
    assert works[-1] < 0.1 * len(x) * 64


def test_large_components_stay_exact():
    left = np.array([[2**27, -(2**27)], [2**27 - 1, 5]])
    right = np.array([[-(2**27), 2**27], [2**27, 5]])
    assert codes.squares_between(left, right).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in right] for x in left]


BAD = [(1, None, 0), (2, [None, 1.0, 0.0, 0.0], 0), (3, [float("nan"), 1.0, 0.0, 0.0], 0), (4, [float("inf"), 0.0, 0.0, 0.0], 0)]


def test_odd_rows(spark):
    rows = [*BAD, (9, [0.5, 0.25, -0.001, 1.0], 1), (9, [0.5, 0.25, -0.001, 1.0], 1), (None, [0.1, 0.1, 0.1, 0.1], None), (7, [], None), (8, [0.5], 2), (10, [3e38, 0.0, 0.0, 0.0], 2)]
    found, _ = codes.compress(table(spark, rows))
    found = {(r.vec_id, r.q, r.part) for r in found.collect()}
    assert found == {(i, 1, 2) for i in (7, 8, 9, 10, None)}
    one = codes.compress(table(spark, rows[4:6]))[0].collect()
    assert [(r.code, r.error) for r in one] == [("00000000", 0)] * 2
    assert codes.compress(table(spark, BAD))[0].collect() == []
    assert codes.compress(table(spark, []))[0].columns == ["vec_id", "label", "q", "part", "code", "error"]
    wide = coded(spark, [(i, [i / 10, 1.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(5)])
    assert wide == brute([(i, [i / 10, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(5)])
    with pytest.raises(ValueError):
        codes.compress(table(spark, rows), entries=257)


def test_query_sums_errors_by_label(spark, tmp_path):
    chance = np.random.default_rng(2)
    rows = [(i, [float(x) for x in chance.normal(size=8)], None if i % 3 == 0 else i % 5) for i in range(600)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = codes.op13_codes(spark, str(tmp_path)).collect()
    assert (sorted((r.code, r.error) for r in found), {r.codebooks_sha256 for r in found}) == (lambda b: (b[0], {b[1]}))(brute([r[:2] for r in rows]))
    label = {i: x for i, _, x in rows}
    for r in found:
        assert r.label_error == sum(s.error for s in found if label[s.vec_id] == label[r.vec_id])
