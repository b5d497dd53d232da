from collections import defaultdict

import pytest

from tickerloom.llm import mixing
from tickerloom.llm.mixing import mix_sources, mixed_documents

SCHEMA = "doc_id long, text string, source string, size string, target int, copies string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


def targets(sizes, share=1.5, repeats=2, weights=(5, 2, 1)):
    """Reshare the excess by weight until no source is above its cap, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > repeats * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.fixture(scope="module")
def documents():
    return [(i, " ".join(["w"] * (1 + i * 7 % 13)), None if i % 11 == 0 else f"s{i % 5}") for i in range(300)]


def test_targets_and_taken_words(spark, documents):
    found = mix_sources(table(spark, documents)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 13
    assert sum(taken.values()) <= sum(want.values()) + 1e-6


def test_reruns_and_partitions_agree(spark, documents):
    once = sorted(map(str, mix_sources(table(spark, documents)).collect()))
    again = sorted(map(str, mix_sources(table(spark, documents[::-1]).repartition(7)).collect()))
    assert once == again


def test_null_empty_repeated_and_tied_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "u v", "a"), (3, "u v", "a"), (None, "one two three", None), (4, "x", "b"), (4, "y", "b"), (5, "w " * 40_000, "b")]
    found = mix_sources(table(spark, rows)).collect()
    assert sorted(r.size for r in found) == [0, 0, 1, 1, 2, 2, 3, 40_000]
    assert all(r.taken == 0 for r in found if r.size == 0)
    assert len({r.copies for r in found if r.doc_id == 3}) == 1
    assert len({r.copies for r in found if r.doc_id == 4}) == 1


@pytest.mark.parametrize("texts", [["w " * 10], [f"{i} " * 10 for i in range(9)], [f"{i} " * 10 for i in range(900)]])
def test_rows_without_id_reach_the_target(spark, texts, monkeypatch):
    monkeypatch.setattr(mixing, "LIST", 64)
    rows = [(None, texts[i % len(texts)], "b") for i in range(900)] + [(i, "w " * 10, "a") for i in range(1100)]
    docs = table(spark, rows)
    found = mix_sources(docs).collect()
    taken = defaultdict(int)
    for r in found:
        taken[r.source] += r.taken
    want = targets({"a": 11000, "b": 9000})
    assert len(found) == 2000
    assert all(abs(taken[s] - want[s]) <= 20 for s in want)
    assert {r.taken for r in found if r.source == "b"} == {0, 10}
    kept = mixed_documents(docs)
    assert {r.source: 10 * r["count"] for r in kept.groupBy("source").count().collect()} == taken
    again = mix_sources(docs.repartition(5, "target", "text")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_sources_without_words(spark):
    found = mix_sources(table(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r.target, r.taken) for r in found] == [(0.0, 0), (0.0, 0)]


def test_empty_table(spark):
    assert mix_sources(table(spark, [])).collect() == []
    assert mixed_documents(table(spark, [])).collect() == []


def test_mixed_documents_keep_columns_and_copies(spark, documents):
    docs = table(spark, documents)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.copies for r in mix_sources(docs).collect() if r.copies}
    got = defaultdict(int)
    for r in out.collect():
        assert (r.size, r.target, r.copies) == ("x", 7, "y")
        got[r.doc_id] += 1
    assert got == want
