import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tickerloom.llm import arrays, periodic

SCHEMA = "doc_id long, text string, runs string, n_words string, word int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "r", "n", 1) for i, t in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words):
    """Every period by itself: stretches of words equal to the one a period before, smallest period only."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            if length >= max(6, 4 * q):
                own = words[start : start + length]
                if not any(all(own[k] == own[k - p] for k in range(p, length)) for p in range(1, q)):
                    out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def periodic_words(chance, letters, n):
    words = []
    while len(words) < n:
        unit = [chance.choice(letters) for _ in range(chance.randint(1, 7))]
        words += unit * chance.randint(1, 9)
    return words[:n]


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefghijkl"])
def test_runs_equal_brute_force(letters):
    chance = random.Random(letters)
    for n in (*range(0, 30), 60, 120, 300):
        for _ in range(6):
            words = periodic_words(chance, letters, n)
            numbers = [ord(w) for w in words]
            assert periodic.runs_of(numbers) == brute(words), words


def test_fibonacci_and_one_word():
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    for text in (b, "a" * 200, "ab" * 100 + "a", "aab" * 50 + "ab" * 50, ("a" * 9 + "b") * 20):
        assert periodic.runs_of([ord(c) for c in text]) == brute(list(text))


def test_sieve_keeps_every_run():
    """All words of every run lie in one stretch, in texts with all three-word sequences repeated within the period, too."""
    chance = random.Random(3)
    texts = [periodic_words(chance, "ab", 200) for _ in range(60)] + [periodic_words(chance, "abcdefgh", 200) for _ in range(60)]
    texts += [list("0000100110101111" * 6), list("a" * 6), list("ab" * 4), []]
    import pyarrow as pa

    words = arrays.Words(pa.array([" ".join(t) for t in texts]))
    assert periodic._runs_of_piece(words, 6, 4) == [brute(t) for t in texts]


def test_operator_on_odd_rows(spark):
    rows = [
        (1, "a b a b\ta b\n a b x"),
        (1, "a b a b\ta b\n a b x"),
        (2, None),
        (3, ""),
        (4, " \t "),
        (None, "z z z z z z"),
        (5, "z z z z z"),
        (6, "é é é é é é ü"),
        (7, "a b a b a b a b a b a b"),
    ]
    found = {(r.doc_id, r.collapsed): r for r in periodic.collapse_runs(table(spark, rows)).collect()}
    assert periodic.collapse_runs(table(spark, rows)).count() == len(rows)
    for i, text in rows:
        words = words_of(text)
        row = found[(i, " ".join(kept(words, brute(words))))]
        assert [tuple(x) for x in row.runs] == brute(words)
        assert (row.n_words, row.word) == (len(words), 1)
    assert periodic.collapse_runs(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic.collapse_runs(table(spark, rows), least_periods=2)


def test_long_text():
    chance = np.random.default_rng(0)
    unit = [str(x) for x in chance.integers(0, 50, 900)]
    words = [str(x) for x in chance.integers(0, 10**6, 100_000)] + unit * 100 + ["end"] * 20_000
    import pyarrow as pa

    piece = arrays.Words(pa.array([" ".join(words)]))
    runs = periodic._runs_of_piece(piece, 6, 4)[0]
    # a unit's own short runs come once a copy
    assert (190_000, 20_000, 1) in runs
    assert max(runs, key=lambda r: r[1]) == (100_000, 90_000, 900)
    text = periodic._kept_text(piece, [runs])[0].as_py().split(" ")
    assert text == kept(words, runs)


def planted(doc_id, words):
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(kept(words, runs))),
    )


def test_query_equals_brute_force(spark, tmp_path):
    chance = random.Random(9)
    rows = [(i, " ".join(periodic_words(chance, "abcdefghij", chance.randint(0, 150)))) for i in range(300)]
    rows += [(i, " ".join(f"w{chance.randint(0, 400)}" for _ in range(chance.randint(0, 250)))) for i in range(300, 700)]
    rows += [(None, "a a a a a a a"), (700, None), (700, None), (701, "")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(r) for r in periodic.op12_periodic(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted((expected(i, t) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in found) > 100
