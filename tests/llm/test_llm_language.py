import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickerloom.llm import language
from tickerloom.llm.language import KernelClassifier, identify, ngram_codes

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int, row string, known int"
WORDS = {"en": "the and ing tion with house that", "de": "der und ung schl keit häuser ß", "fr": "le et eau tion maison être ç"}


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, "y", 2) for i, t, g in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    chance = np.random.default_rng(1)
    return [(i, " ".join(chance.choice(WORDS[g].split(), int(chance.integers(8, 60)))), g) for i, g in enumerate(chance.choice(list(WORDS), 300))]


def test_held_out_accuracy(spark, rows):
    found = {r.doc_id: r for r in identify(table(spark, rows)).collect()}
    assert len(found) == len(rows)
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, _ in held} == {i for i, r in found.items() if r.held_out}
    assert np.mean([found[i].lang_pred == g for i, g in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = identify(docs).where("held_out").collect()
    assert np.mean([known[r.doc_id] == r.lang_pred for r in found]) >= 0.95


def test_labels_and_ids_of_held_out_rows_do_not_matter(spark, rows):
    plain = sorted(map(tuple, identify(table(spark, rows)).collect()))
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in rows]
    assert sorted(map(tuple, identify(table(spark, other)).collect())) == plain


def test_edge_rows(spark, rows):
    extra = [(9001, None, "en"), (9002, "", "en"), (9003, "12 34 !!", "de"), (None, "the house and that", None), (9004, "der und ung " * 30_000, "de"), (9004, "der und ung " * 30_000, "de"), (9005, "語語語", None), (9006, "\U0001d400 the", None)]
    found = identify(table(spark, rows + extra)).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert all((by[i][0].lang_pred, by[i][0].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert by[None][0].lang_pred == "en"
    assert len(by[9004]) == 2 and {r.lang_pred for r in by[9004]} == {"de"}
    assert by[9005][0].lang_pred in WORDS


def test_nothing_to_learn_and_empty_table(spark):
    found = identify(table(spark, [(1, "text here", None), (2, "more", None)])).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * 2
    assert identify(table(spark, [])).collect() == []


def test_kernel_is_normalised_presence_of_common_ngrams(rows):
    texts = [t for _, t, _ in rows[:40]]
    codes = ngram_codes(pa.array(texts))
    model = KernelClassifier(codes, ["a", "b"] * 20)
    order = np.linspace(0, 39, 40).astype(int)
    kernel = model.kernel(codes)

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t)
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    for i in range(0, 40, 7):
        for j in range(0, 40, 5):
            a, b = grams(texts[i]), grams(texts[order[j]])
            assert kernel[i, j] == pytest.approx(len(a & b) / np.sqrt(len(a) * len(b)), rel=1e-4)


def test_fit_takes_a_bounded_sample(spark, rows, monkeypatch):
    taken = []
    monkeypatch.setattr(language, "KernelClassifier", lambda codes, labels: taken.extend(labels))
    language.fit(table(spark, rows).select("text", "lang"), per_language=10)
    assert sorted(taken) == ["de"] * 10 + ["en"] * 10 + ["fr"] * 10


def test_languages_of_long_texts_are_learnt(spark):
    chance = np.random.default_rng(1)
    say = lambda words, n: " ".join(chance.choice(words.split(), n))
    rows = [(i, "1 " * 50 + say(WORDS["de"], 2600), "de") for i in range(60)] + [(100 + i, say(WORDS["en"], 12), "en") for i in range(60)]
    found = {r.doc_id: r.lang_pred for r in identify(table(spark, rows)).collect()}
    assert all(found[i] == g for i, _, g in rows)


def test_few_usable_rows_of_a_large_language_are_all_learnt(spark, monkeypatch):
    rows = [(i, None if i % 50 else f"the house {i}", "en") for i in range(2000)]
    taken = []
    monkeypatch.setattr(language, "KernelClassifier", lambda codes, labels: taken.extend(labels))
    language.fit(table(spark, rows).select("doc_id", "text", "lang"), per_language=30)
    assert len(taken) == 30


def test_every_language_has_landmarks():
    assert language.in_turn(["a", "a", "a", "b", "a", "c"]).tolist() == [0, 3, 5, 1, 2, 4]


def test_classifier_equals_plain_regression(rows):
    """Kernel, root and regression worked out again, text by text."""
    labels = [g for *_, g in rows[:60]]
    texts = [t for _, t, _ in rows[:60]]
    codes = [set(c.tolist()) for c in ngram_codes(pa.array(texts))]
    model = KernelClassifier(ngram_codes(pa.array(texts)), labels)
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in codes] for a in codes])
    values, vectors = np.linalg.eigh(kernel)
    features = kernel @ vectors / np.sqrt(values)
    target = np.array([[1.0 if g == x else -1.0 for x in sorted(set(labels))] for g in labels])
    weights = np.linalg.solve(features.T @ features + language.RIDGE * len(texts) * np.eye(len(texts)), features.T @ target)
    found, score = model.predict(ngram_codes(pa.array(texts)))
    output = np.clip((features @ weights + 1) / 2, 1e-6, 1)
    assert found == [sorted(set(labels))[i] for i in output.argmax(axis=1)]
    assert score == pytest.approx(output.max(axis=1) / output.sum(axis=1), abs=1e-3)
