import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickerloom.llm import ngrams
from tickerloom.llm.ngrams import context_bucket, mixture_weights, packed, score_texts, unpacked

SCHEMA = "doc_id long, text string, words string, batch string, kind string, score int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    chance = np.random.default_rng(6)
    rows = []
    for i in range(250):
        words, at = [], 0
        for _ in range(int(chance.integers(0, 60))):
            at = (at * 3 + int(chance.integers(0, 4))) % 50
            words.append(f"W{at}" if at % 2 else f"w{at}")
        rows.append((i, " ".join(words)))
    return [*rows, (900, None), (901, ""), (None, "w1 unseen"), (902, rows[5][1]), (902, rows[5][1]), (903, "w1 " * 20_000), (904, "É é ß")]


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def held(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 7 == 2


def test_counts_base_and_model(spark, corpus, monkeypatch):
    weights = []
    original = ngrams.mixture_weights
    monkeypatch.setattr(ngrams, "mixture_weights", lambda *a: weights.append(original(*a)) or weights[-1])
    found = score_texts(table(spark, corpus)).collect()
    one, two, texts = Counter(), Counter(), 0
    for doc, text in corpus:
        if not held(doc):
            own = tokens(text)
            texts += 1
            one.update(own)
            two.update(zip(["^", *own], own))
    n, v, (own,) = sum(one.values()), len(one), weights
    one["^"] = texts

    def model(text):
        total, before = 0.0, "^"
        for t in tokens(text):
            l1, l2, l3 = own[context_bucket(np.array([one[before]]))[0]]
            total += math.log10(l1 / (v + 1) + l2 * one[t] / n + (l3 * two[before, t] / one[before] if one[before] else 0))
            before = t
        return total

    want = [
        (d, held(d), len(tokens(t)), sum(one[x] > 0 for x in tokens(t)), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in tokens(t)), model(t))
        for d, t in corpus
    ]
    key = lambda r: (str(r[0]), r[2], r[5])
    for got, exp in zip(sorted(map(tuple, found), key=key), sorted(want, key=key), strict=True):
        assert got[:5] == exp[:5]
        assert got[5:] == pytest.approx(exp[5:], rel=1e-9)
    loose = [(r.score, r.base_score) for r in found if r.held_out]
    assert sum(s for s, _ in loose) > sum(b for _, b in loose)


def test_model_is_a_distribution():
    weights = mixture_weights([(0, 5, 40, 0), (1, 10, 100, 2.0), (3, 50, 400, 40.0)], 1000.0, 50.0)
    assert weights.sum(axis=1) == pytest.approx(np.ones(len(weights)))
    assert (weights[:, 0] > 0).all() and weights[0, 2] == 0
    assert weights[2].tolist() == weights[1].tolist()


def test_em_raises_the_likelihood():
    cells = [(2, 30, 900.0, 0.0), (2, 60, 300.0, 45.0), (2, 5, 0.0, 0.0)]
    found = mixture_weights(cells, 1000.0, 99.0)[2]

    def likelihood(w):
        return sum(n * math.log(w[0] / 100 + w[1] * a / n / 1000 + w[2] * p / n) for _, n, a, p in cells)

    chance = np.random.default_rng(0)
    assert all(likelihood(found) >= likelihood(w) - 1e-6 for w in chance.dirichlet([1, 1, 1], 500))


def test_reruns_agree(spark, corpus):
    once = sorted(map(str, score_texts(table(spark, corpus)).drop("score").collect()))
    assert once == sorted(map(str, score_texts(table(spark, corpus[::-1]).repartition(5)).drop("score").collect()))


def test_empty_table_and_nothing_to_learn(spark):
    assert score_texts(table(spark, [])).collect() == []
    doc = next(i for i in range(100) if held(i))
    (row,) = score_texts(table(spark, [(doc, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_packed_numbers_come_back():
    values = np.array([0, 1, 255, 256, 2**55, 3], np.uint64)
    assert unpacked(packed(values)).tolist() == values.tolist()
    assert unpacked(packed(values[:0])).tolist() == []


def test_scores_do_not_follow_the_partitions(spark, corpus):
    key = "spark.sql.shuffle.partitions"
    was, found = spark.conf.get(key), []
    for n in (2, 8, 32):
        spark.conf.set(key, n)
        found.append(sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in score_texts(table(spark, corpus)).collect()))
    spark.conf.set(key, was)
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)


def test_weights_equal_brute_force(spark, corpus, monkeypatch):
    """Held-out events counted one by one, then expectation maximisation over the events themselves."""
    from pyspark.sql import functions as F

    weights = []
    original = ngrams.mixture_weights
    monkeypatch.setattr(ngrams, "mixture_weights", lambda *a: weights.append(original(*a)) or weights[-1])
    monkeypatch.setattr(ngrams, "FINE", 64)
    score_texts(table(spark, corpus)).collect()
    rows = table(spark, corpus).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("aside", F.pmod(F.xxhash64("doc_id", "text", F.lit("held")), F.lit(ngrams.HELD)) == 0).collect()
    one, two, all_, rest = Counter(), Counter(), Counter(), 0
    for r in rows:
        if not held(r.doc_id):
            all_.update(tokens(r.text))
            if not r.aside:
                rest += 1
                one.update(tokens(r.text))
                two.update(zip(["^", *tokens(r.text)], tokens(r.text)))
    one["^"] = rest
    n, v = sum(all_.values()), len(all_)
    events = {}
    for r in rows:
        if r.aside and not held(r.doc_id):
            before = "^"
            for t in tokens(r.text):
                c = one[before]
                events.setdefault(int(context_bucket(np.array([c]))[0]), []).append((1 / (v + 1), one[t] / n, two[before, t] / c if c else 0.0))
                before = t
    assert len(events) >= 4
    for b, given in events.items():
        given = np.array(given).T
        own = np.full(3, 1 / 3) if b else np.array([0.5, 0.5, 0.0])
        for _ in range(ngrams.ROUNDS):
            part = own[:, None] * given
            own = (part / part.sum(axis=0)).mean(axis=1)
        assert weights[0][b] == pytest.approx(own, abs=0.02)
