from collections import Counter

import pytest

import corpus_pipeline
from tickerloom.llm import unigram

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    text = lambda i, n=30: " ".join(f"word{i}x{k}" for k in range(n))
    rows = [(i, text(i), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, text(i) + " end", "en", "s0") for i in range(5)]  # near copies
    rows += [(200, None, "en", "s0"), (201, "", "en", None), (202, "12 34", None, "s1"), (203, text(203) + " mail me@home.org now", None, None)]
    return rows


def test_stages_in_order(spark, rows):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "replace_personal_data", "mix_sources", "encode_pieces"]
    docs = table(spark, rows)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        names = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == names
        kept.append(docs.collect())
    assert sorted(r.doc_id for r in kept[0]) == sorted(i for i, *_ in rows if i not in (200, 201, 202))
    assert sorted(r.doc_id for r in kept[1]) == [*range(40), 203]
    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in kept[1]}
    changed = {r.doc_id for r in kept[2] if r.text != dict((i, t) for i, t, *_ in rows)[r.doc_id]}
    assert changed == {203} and "me@home.org" not in next(r.text for r in kept[2] if r.doc_id == 203)
    copies = Counter(r.doc_id for r in kept[3])
    assert set(copies.values()) <= {1, 2} and 55 <= sum(copies.values()) <= 62
    _, last = corpus_pipeline.STAGES[-1]
    coded = last(spark, docs, "")
    assert all(r.round_trip for r in coded.collect())
    assert Counter(r.doc_id for r in unigram.decode(coded).collect()) == copies


def test_empty_documents(spark):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == table(spark, []).columns
        assert docs.collect() == []
        docs = table(spark, [])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").collect() == []


def test_run_over_supplied_documents(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "ids", "n_pieces", "round_trip"]
    assert found.where("not round_trip").count() == 0 and found.count() > 200


def test_unlabelled_corpus_stays_and_unlabelled_documents_are_told(spark, rows):
    bare = table(spark, [(i, f"the house number {i} stands with roof and door", None, "s") for i in range(10)])
    assert corpus_pipeline.identify_language(spark, bare, "").count() == 10
    some = corpus_pipeline.identify_language(spark, table(spark, rows), "")
    assert {(r.doc_id, r.lang) for r in some.where("doc_id = 203").collect()} == {(203, "en")}
