import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tickerloom.llm import substring
from tickerloom.llm.substring import repeated_windows, without_repeats

SCHEMA = "doc_id long, text string, n_words string, rid string, spans int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((doc, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    chance = np.random.default_rng(4)
    shared = [[f"s{k}_{x}" for x in range(60)] for k in range(5)]
    rows = []
    for i in range(120):
        words = [f"w{x}" for x in chance.integers(0, 300, int(chance.integers(0, 150)))]
        for part in chance.integers(0, 5, int(chance.integers(0, 3))):
            begin, end = sorted(chance.integers(0, 61, 2))
            at = int(chance.integers(0, len(words) + 1))
            words[at:at] = shared[part][begin:end]
        rows.append((i, (" " if i % 2 else "\n ").join(words)))
    rows += [(500 + i, rows[7][1]) for i in range(4)] + [rows[9], (600, "a " * 100), (601, " ".join([*map(str, range(40))] * 2))]
    return rows


@pytest.mark.parametrize("window", [35, 5])
def test_same_as_brute_force(spark, corpus, window):
    assert digest(without_repeats(table(spark, corpus), window=window, keep=["doc_id"])) == brute(corpus, window)


def test_small_pieces_give_the_same(spark, corpus):
    """Copies in many pieces meet through their buckets."""
    assert digest(without_repeats(table(spark, corpus).repartition(60), window=12)) == brute(corpus, 12)


def test_edge_rows_and_columns(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n "), (None, "only here"), (4, long), (5, long + " more"), (6, "Case " * 35), (7, "case " * 35), (8, "é ß 語 " * 12), (8, "é ß 語 " * 12)]
    out = without_repeats(table(spark, rows))
    assert out.columns == ["doc_id", "text", "rid", "spans", "n_words", "n_removed", "kept"]
    assert digest(out) == brute(rows, 35)
    assert {(r.rid, r.spans) for r in out.collect()} == {("y", 1)}


def test_empty_table(spark):
    assert without_repeats(table(spark, [])).collect() == []


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring.arrays, "mix", lambda x: np.zeros_like(x))
    word = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    found = repeated_windows(word, np.arange(7), 3, np.zeros(7, bool))
    assert found.tolist() == [True, False, False, False, False, False, True]


def test_spans_of_rows_alike_are_told_once(spark, monkeypatch):
    """Many rows without an id and with one text: each carries the spans of one text, not those of all."""
    from pyspark.sql import functions as F

    from tickerloom.llm import substring

    text = " ".join(f"w{i % 97}x{i}" for i in range(300))
    df = spark.createDataFrame([(None, text)] * 3000, "doc_id long, text string")
    sizes = []
    plain = substring.covered_words
    monkeypatch.setattr(substring, "covered_words", lambda packed, **how: sizes.append(plain(packed, **how)) or sizes[-1])
    found = substring.without_repeats(df).groupBy("n_words", "n_removed", "kept").count().collect()
    assert [tuple(r) for r in found] == [(300, 300, "", 3000)]
    per_row = sizes[0].groupBy("rid").agg(F.size(F.collect_set(F.struct("a", "b"))).alias("n")).first()["n"]
    assert per_row <= 300
