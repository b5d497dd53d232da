import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tickerloom.llm import unigram
from tickerloom.llm.unigram import GAP, MARK, MODEL, DoubleArrayTrie, Pieces, decode, encode

SCHEMA = "doc_id long, text string, ids string, x int, row string"
TEXTS = ["Hello world", "", None, " two  spaces ", "Été ▁ 日本 \n\tx", "😀x", "\x00y", " ", "\n", "word " * 3, "a" * 500, "   ", "…—’", "\U0010ffff"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL)


@pytest.fixture(scope="module")
def scores():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in plain}


def table(spark, texts):
    return spark.createDataFrame([(i, t, "old", 1, "y") for i, t in enumerate(texts)], SCHEMA)


def best_score(text, scores, unknown):
    """Viterbi by the book, over the whole text. A literal marker is an unknown character."""
    chars = [MARK, *(MARK if c == " " else "" if c == MARK else c for c in text)] if text else []
    best = [0.0] + [-np.inf] * len(chars)
    for end in range(1, len(chars) + 1):
        for begin in range(max(0, end - 16), end):
            part = "".join(chars[begin:end])
            if part in scores:
                best[end] = max(best[end], best[begin] + scores[part])
            elif end - begin == 1:
                best[end] = max(best[end], best[begin] + unknown)
    return best[-1]


def test_segmentations_score_best(pieces, scores):
    docs = [t for t in TEXTS if t] + ["Thedre forrendsten the or", "Réleou eauoué.\nLes", "x" * 40 + " y z"]
    chance = np.random.default_rng(1)
    letters = list("abcdeé  \n▁日tionthe")
    docs += ["".join(chance.choice(letters, int(chance.integers(1, 40)))) for _ in range(150)]
    ids, counts, same = pieces.encode(pa.array(docs))
    assert same.all()
    known = {i: s for i, s in enumerate(pieces.score)}
    at = 0
    for text, n in zip(docs, counts, strict=True):
        own = ids[at : at + n].tolist()
        at += n
        lost = sum(c == MARK or (c != " " and c not in scores) for c in text)
        assert sum(known[i] for i in own) + lost * pieces.unknown == pytest.approx(best_score(text, scores, pieces.unknown))


def test_round_trip_and_library_decoding(pieces):
    texts = pa.array(TEXTS)
    ids, counts, same = pieces.encode(texts)
    assert same.all()
    data, lengths = pieces.decode(ids, counts)
    raw, ends = data.tobytes(), np.cumsum(lengths)
    assert [raw[e - n : e].decode() for e, n in zip(ends, lengths, strict=True)] == [t or "" for t in TEXTS]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    at = 0
    for text, n in zip(TEXTS, counts, strict=True):
        assert model.decode(ids[at : at + n].tolist()) == (text or "")
        at += n


def test_trie_finds_exactly_its_keys():
    chance = np.random.default_rng(0)
    keys = sorted({bytes(chance.integers(0, 256, int(chance.integers(1, 6)), dtype=np.uint8)) for _ in range(2000)} | {b"a", b"ab", b"abc", bytes([GAP])})
    trie = DoubleArrayTrie(keys, list(range(len(keys))))

    def find(key):
        state = 0
        for byte in key:
            following = trie.base[state] + byte
            if not trie.base[state] or following >= len(trie.check) or trie.check[following] != state:
                return -1
            state = following
        return trie.piece[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    inside = set(keys)
    for key in keys:
        for other in (key[:-1], key + b"\x00", key[::-1]):
            if other not in inside:
                assert find(other) == -1


def test_tables(spark):
    long = "long text " * 30_000
    texts = [*TEXTS, long, "Hello world"]
    out = encode(table(spark, texts))
    assert out.columns == ["doc_id", "text", "x", "row", "ids", "n_pieces", "round_trip"]
    rows = decode(out).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == texts
    assert all(r.round_trip and (r.x, r.row) == (1, "y") for r in rows)
    assert [r.n_pieces for r in rows] == [len(r.ids or []) for r in rows]
    assert rows[2].ids is None and rows[1].ids == [] and rows[0].ids == rows[-1].ids
    assert encode(table(spark, [])).collect() == []


def test_decoding_foreign_ids(spark):
    df = spark.createDataFrame([([99_999, -1],), ([258, 258],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in decode(df).collect()] == ["", "��", None, ""]


def test_parts_and_windows_change_nothing(pieces, monkeypatch):
    chance = np.random.default_rng(2)
    letters = list("abcdeé  日tionthexyz")
    texts = ["".join(chance.choice(letters, int(n))) for n in chance.integers(0, 400, 60)] + [None, "", "x" * 700, " " * 300, "thetion" * 90 + " end"]
    whole = pieces.encode(pa.array(texts))
    monkeypatch.setattr(unigram, "PART_BYTES", 50)
    parts = pieces.encode(pa.array(texts))
    monkeypatch.setattr(unigram, "LONG", 24)
    windows = pieces.encode(pa.array(texts))
    for other in (parts, windows):
        assert [x.tolist() for x in other] == [x.tolist() for x in whole]


def test_damage_is_told(pieces):
    marked = np.frombuffer(b"\xffab\xffab", np.uint8)
    ids, counts, _ = pieces.encode(pa.array(["ab", "ab"]))
    edges = np.array([0, 3, 6])
    assert pieces._same(ids, counts, marked, edges).all()
    other = ids.copy()
    other[-1] = pieces.byte_ids[ord("z")]
    assert pieces._same(other, counts, marked, edges).tolist() == [True, False]


@pytest.mark.parametrize("kind", ["unspaced", "spaced"])
def test_memory_is_bounded(pieces, kind):
    import tracemalloc

    chance = np.random.default_rng(3)
    text = bytes(chance.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789" + (b" " * 7 if kind == "spaced" else b""), np.uint8), 300_000 if kind == "unspaced" else 8_000_000)).decode()
    texts = pa.array([text])
    tracemalloc.start()
    ids, counts, same = pieces.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert same.all() and counts.tolist() == [len(ids)]
    assert peak < 100e6 + 12 * len(text)
