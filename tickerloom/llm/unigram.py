"""SentencePiece unigram encoding by Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays

#: Folder and name of the pieces; the file itself is not part of this repository.
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Stands for the whitespace marker inside the trie and the texts: a byte that UTF-8 never has.
GAP = 0xFF
#: An unknown character costs so much more than the worst piece.
UNKNOWN_COST = 10.0
#: Bytes of text worked on at once, cut between words; a word beyond ``LONG`` bytes is worked through in windows of that size.
PART_BYTES, LONG = 256 << 10, 16 << 10


class DoubleArrayTrie:
    """``check[base[s] + c] == s`` where state ``s`` goes on with byte ``c``; ``piece[s]`` is the piece ending there, or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in zip(keys, values, strict=True):
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][byte]
            ends[node] = value
        used = np.zeros(len(children) * 4 + 1024, bool)
        base, check, piece = (np.full(len(used), x, np.int32) for x in (0, -1, -1))
        used[0] = True
        state = {0: 0}
        # states with one child fill the holes from the front; those with more are laid further and further back
        hole = back = 1
        todo = [0]
        for node in todo:
            marks = np.array(sorted(children[node]), np.int64)
            if not len(marks):
                continue
            if len(marks) == 1:
                while used[hole] or hole <= marks[0]:
                    hole += 1 if used[hole] else marks[0] - hole + 1
                at = hole - int(marks[0])
            else:
                at = back
                while used[at + marks].any():
                    at += 1
                back = at
            base[state[node]] = at
            slots = at + marks
            used[slots] = True
            check[slots] = state[node]
            for byte, slot in zip(marks.tolist(), slots.tolist(), strict=True):
                child = children[node][byte]
                piece[slot] = ends[child]
                state[child] = slot
                todo.append(child)
        size = int(np.flatnonzero(used)[-1]) + 257
        self.base, self.check, self.piece = base[:size], check[:size], piece[:size]


class Pieces:
    """A vocabulary: pieces with log scores, the bytes to fall back on, and the bytes each piece decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i).encode().replace(MARK.encode(), bytes([GAP])) for i in plain}
        score = {i: model.get_score(i) for i in plain}
        of_byte = {int(model.id_to_piece(i)[3:-1], 16): i for i in ids if model.is_byte(i)}
        if len(of_byte) < 256:
            raise ValueError("the vocabulary has no bytes to fall back on")
        self.byte_ids = np.array([of_byte[b] for b in range(256)], np.int32)
        # A text is cut before each run of markers, which is exact if no piece goes on with a marker after another character.
        if any(GAP in x.lstrip(bytes([GAP])) for x in text.values()):
            raise ValueError("pieces span words; texts can't be cut into words")
        self.trie = DoubleArrayTrie([text[i] for i in plain], plain)
        self.score = np.zeros(len(ids), np.float64)
        self.score[plain] = [score[i] for i in plain]
        self.unknown = min((x for x in score.values() if x > -1e8), default=0.0) - UNKNOWN_COST
        raw = [text[i].replace(bytes([GAP]), b" ") if i in text else b"" for i in ids]
        for byte, i in of_byte.items():
            raw[i] = bytes([byte])
        self.raw_lengths = np.array([len(x) for x in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.longest = max(map(len, text.values()), default=4) + 4

    def _edges(self, data: np.ndarray, place: np.ndarray, limit: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of every piece that starts at one of the places; -1 for a character that is none."""
        trie = self.trie
        at, state, depth = place, np.zeros(len(place), np.int64), 0
        tail, head_of, piece = [], [], []
        alone = np.zeros(len(data), bool)  # places whose first character is a piece
        while len(at):
            byte = data[at + depth].astype(np.int64)
            following = trie.base[state].astype(np.int64) + byte
            inside = (following < len(trie.check)) & (trie.base[state] > 0)
            following = np.where(inside, following, 0)
            alive = inside & (trie.check[following] == state)
            at, state = at[alive], following[alive]
            depth += 1
            got = trie.piece[state]
            has = got >= 0
            tail.append(at[has])
            head_of.append(at[has] + depth)
            piece.append(got[has])
            one = at[has & (follow[at] == depth)]
            alone[one] = True
            going = at + depth < limit[at]
            at, state = at[going], state[going]
        lost = place[~alone[place]]
        tail.append(lost)
        head_of.append(np.minimum(lost + follow[lost], limit[lost]))
        piece.append(np.full(len(lost), -1, np.int32))
        return np.concatenate(tail), np.concatenate(head_of), np.concatenate(piece)

    def segment_long(self, data: np.ndarray) -> np.ndarray:
        """Piece ids of one word of any length, window by window.

        Past a window, the best paths to all places that are still open are
        followed back to the place where they meet; what lies before it is done and
        let go. Of equal scores the longest last piece wins, as in ``segment``.
        """
        n, best, back, done = len(data), {0: 0.0}, {}, 0
        out: list[np.ndarray] = []
        for begin in range(0, n, LONG):
            own = data[begin : begin + LONG + self.longest]
            size = min(LONG, n - begin)
            head = (own & 0xC0) != 0x80
            follow = np.where(own >= 0xF0, 4, np.where(own >= 0xE0, 3, np.where(own >= 0xC0, 2, 1)))
            follow = np.where(own == GAP, 1, follow)
            tail, to, piece = self._edges(own, np.flatnonzero(head[:size]), np.full(len(own), len(own)), follow)
            gain = np.where(piece >= 0, self.score[piece], self.unknown)
            order = np.argsort(tail, kind="stable")
            for source, target, score, name in zip((tail[order] + begin).tolist(), (to[order] + begin).tolist(), gain[order].tolist(), piece[order].tolist(), strict=True):
                if source in best and best.get(target, -np.inf) < (total := best[source] + score):
                    best[target], back[target] = total, (source, name)
            end = begin + size
            best = {k: v for k, v in best.items() if k >= end}
            ahead = sorted(best)
            while len(ahead) > 1:
                last = ahead.pop()
                if last <= done or last not in back:
                    break
                source = back[last][0]
                if source not in ahead:
                    ahead = sorted([*ahead, source])
            if len(ahead) == 1:
                met, path = ahead[0], []
                while met > done:
                    path.append((back[met][0], back[met][1], met))
                    met = back[met][0]
                if path:
                    out.append(self._named(data, path[::-1]))
                    done = path[0][2]
                    back = {k: v for k, v in back.items() if k > done}
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _named(self, data: np.ndarray, path: list[tuple[int, int, int]]) -> np.ndarray:
        """Ids of a path of (begin, piece, end): unknown characters become their bytes."""
        ids: list[int] = []
        for begin, piece, end in path:
            ids += [piece] if piece >= 0 else self.byte_ids[data[begin:end]].tolist()
        return np.array(ids, np.int32)

    def segment(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the words data[start:end], one after the other, and their number per word.

        All words advance together: first every place of every word walks down the
        trie until it dies, then the best scores are worked out place by place.
        Of equal scores the longest last piece wins.
        """
        n = len(data)
        limit = np.zeros(n, np.int64)  # end of the word a place lies in
        order = np.zeros(n, np.int64)  # its place in the word
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        lengths = ends - starts
        where = arrays.spans(starts, lengths)
        limit[where] = np.repeat(ends, lengths)
        order[where] = where - np.repeat(starts, lengths)
        head = (data & 0xC0) != 0x80  # first byte of a character
        place = where[head[where]]
        follow = np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 1)))
        follow = np.where(data == GAP, 1, follow)
        tail, head_of, piece = self._edges(data, place, limit, follow)
        gain = np.where(piece >= 0, self.score[piece], self.unknown)
        # place in the word right after the edge, so that a word's end has a slot of its own
        word = np.repeat(np.arange(len(starts)), lengths)
        of = np.zeros(n, np.int64)
        of[where] = word
        source, target = tail + of[tail], head_of + of[tail]
        step = order[tail] + (head_of - tail)
        rank = np.lexsort((tail, step))
        source, target, gain, piece, step = source[rank], target[rank], gain[rank], piece[rank], step[rank]
        best = np.full(n + len(starts) + 1, -np.inf)
        best[starts + np.arange(len(starts))] = 0.0
        back = np.full(len(best), -1, np.int64)
        edges = np.flatnonzero(np.diff(step, prepend=-1))
        for begin, end in zip(edges, np.append(edges[1:], len(step)), strict=True):
            score = best[source[begin:end]] + gain[begin:end]
            to = target[begin:end]
            np.maximum.at(best, to, score)
            win = np.flatnonzero(score == best[to])[::-1]
            back[to[win]] = begin + win
        # walk back from the ends of all words at once
        out_word, out_piece, out_at = [], [], []
        at, alive = ends + np.arange(len(starts)), np.flatnonzero(lengths > 0)
        at = at[alive]
        while len(alive):
            edge = back[at]
            out_word.append(alive)
            out_piece.append(piece[edge])
            out_at.append(source[edge])
            at = source[edge]
            going = at > (starts + np.arange(len(starts)))[alive]
            at, alive = at[going], alive[going]
        if not out_word:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        out_word, out_piece, out_at = np.concatenate(out_word), np.concatenate(out_piece), np.concatenate(out_at)
        rank = np.lexsort((out_at, out_word))
        out_word, out_piece, out_at = out_word[rank], out_piece[rank], out_at[rank]
        # an unknown character becomes its bytes
        first = out_at - out_word
        size = np.where(out_piece >= 0, 1, np.minimum(follow[first], limit[first] - first))
        flat = arrays.spans(first, size)
        ids = np.where(np.repeat(out_piece, size) >= 0, np.repeat(out_piece, size), self.byte_ids[data[flat]]).astype(np.int32)
        return ids, np.bincount(out_word, size, len(starts)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, their number per text, and whether they spell the text. A text starts with a marker; an empty one has no ids.

        Texts are worked through in parts of about ``PART_BYTES``, so what is held
        besides the texts and their ids doesn't grow with them.
        """
        data, offsets = arrays.buffers(texts)
        counts, same, ids = np.zeros(len(texts), np.int64), np.ones(len(texts), bool), []
        begin, text = 0, 0
        while begin < len(data):
            end = _cut(data, offsets, begin + PART_BYTES)
            while offsets[text + 1] <= begin:
                text += 1
            last = int(np.searchsorted(offsets, end, "left"))  # texts text .. last - 1 have bytes here
            edges = np.clip(offsets[text : last + 1], begin, end)
            found, number, spelt = self._encode_part(data[begin:end], edges - begin, offsets[text] < begin)
            ids.append(found)
            counts[text:last] += number
            same[text:last] &= spelt
            begin = end
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts, same

    def _encode_part(self, data: np.ndarray, offsets: np.ndarray, goes_on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, each with the markers before it, are segmented once per part, however often they occur. ``goes_on``: the first text began before."""
        size = np.diff(offsets)
        led = size > 0
        led[0] &= not goes_on
        begin = offsets[:-1] + np.cumsum(led) - led  # of each text once every one that starts here has its marker
        marked = np.full(len(data) + int(led.sum()), GAP, np.uint8)
        spaced = np.where(data == 0x20, np.uint8(GAP), data)
        if len(size) == 1:  # the part may be one long word
            marked[len(marked) - len(data) :] = spaced
        else:
            marked[arrays.spans(begin + led, size)] = spaced
        first = marked == GAP
        first[1:] &= marked[:-1] != GAP
        first[begin[size > 0]] = True
        starts = np.flatnonzero(first)
        chunk = np.append(starts, len(marked))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(chunk), pa.py_buffer(marked)]).dictionary_encode()
        words, edge = arrays.buffers(coded.dictionary)
        wide = np.diff(edge)
        short = wide <= LONG
        per_word = np.zeros(len(wide), np.int64)
        ends = np.cumsum(wide[short])
        ids, per_word[short] = self.segment(words[arrays.spans(edge[:-1][short], wide[short])], ends - wide[short], ends)
        first_id = np.cumsum(per_word) - per_word
        for w in np.flatnonzero(~short):
            more = self.segment_long(words[edge[w] : edge[w + 1]])
            first_id[w], per_word[w] = len(ids), len(more)
            ids = np.concatenate([ids, more])
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        through = np.concatenate([[0], np.cumsum(per_word[word])])
        out = ids if len(word) == 1 else ids[arrays.spans(first_id[word], per_word[word])]
        per_text = np.diff(through[np.searchsorted(starts, np.append(begin, len(marked)))])
        return out, per_text, self._same(out, per_text, marked, np.append(begin, len(marked)))

    def _same(self, ids: np.ndarray, per_text: np.ndarray, marked: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Whether the ids of each text decode to its bytes, marked[edges[i]:edges[i + 1]]."""
        reach = np.concatenate([[0], np.cumsum(self.raw_lengths[ids])])
        same = np.diff(reach[np.concatenate([[0], np.cumsum(per_text)])]) == np.diff(edges)
        if same.all():
            for begin in range(0, len(ids), LONG):
                spelt = self._spelt(ids[begin : begin + LONG])[0]
                own = marked[reach[begin] : reach[begin] + len(spelt)]
                wrong = np.flatnonzero(spelt != np.where(own == GAP, np.uint8(0x20), own))
                same[np.searchsorted(edges, wrong + reach[begin], "right") - 1] = False
        return same

    def _spelt(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, markers as spaces, and how many each has."""
        ids = np.where((ids >= 0) & (ids < len(self.raw_lengths)), ids, 0)
        lengths = self.raw_lengths[ids]
        return self.raw[arrays.spans(self.raw_starts[ids], lengths)], lengths

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts and their lengths: markers become spaces, the first space of a text goes."""
        data, lengths = self._spelt(ids)
        size = np.zeros(len(counts) + 1, np.int64)
        size[1:] = np.cumsum(lengths)[np.cumsum(counts) - 1] * (np.cumsum(counts) > 0) if len(ids) else 0
        total = np.diff(size)
        begin = size[:-1]
        drop = begin[(total > 0)][data[begin[total > 0]] == 0x20]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        total = total - np.isin(begin, drop) * (total > 0)
        return data[keep], total


def _cut(data: np.ndarray, offsets: np.ndarray, least: int) -> int:
    """The first place from ``least`` on where a text ends or a run of spaces begins."""
    if least >= len(data):
        return len(data)
    end = int(offsets[np.searchsorted(offsets, least)])
    while least < end:
        own = data[least - 1 : min(least + LONG, end)]
        found = np.flatnonzero((own[1:] == 0x20) & (own[:-1] != 0x20))
        if len(found):
            return least + int(found[0])
        least += LONG
    return end


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _pack(docs: DataFrame, column: str, names: list[str]) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{column}`").alias("x"))


def encode(docs: DataFrame, *, text: str = "text", path: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all), with ``ids array<int>``, ``n_pieces`` and ``round_trip``.

    Each text, led by a marker and with spaces as markers, is cut into the pieces
    whose scores add up to the most; a character that no piece covers becomes its
    UTF-8 bytes, and so does a literal marker. Nothing is normalised, so decoding
    gives the text back; ``round_trip`` says whether it did.

    Null text: null ids, no pieces, round trip true. Empty text: no ids. Ties go
    to the longest last piece. Rows are coded one by one whatever their length,
    so repeated rows are coded alike and an empty table gives an empty result.
    Columns of ``docs`` named like the results are replaced.
    """
    arrays.bounded_batches(docs.sparkSession)
    names = [c for c in (keep or docs.columns) if c not in ("ids", "n_pieces", "round_trip")]
    packed = _pack(docs, text, names)
    row_type = packed.schema["row"].dataType.simpleString()

    def code(batches):
        pieces = load(path)
        for batch in arrays.pieces(batches, "x"):
            texts = batch["x"]
            ids, counts, same = pieces.encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(~np.asarray(texts.is_valid()), False))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(counts), pa.array(same)], ["row", "ids", "n_pieces", "round_trip"]
            )

    return packed.mapInArrow(code, f"row {row_type}, ids array<int>, n_pieces long, round_trip boolean").select("row.*", "ids", "n_pieces", "round_trip")


def decode(coded: DataFrame, *, ids: str = "ids", path: str = MODEL) -> DataFrame:
    """``coded`` with ``decoded``, the text of ``ids``. Null ids: null. Ids outside the vocabulary count as the unknown piece, which is empty. Bytes that are no UTF-8 become U+FFFD."""
    arrays.bounded_batches(coded.sparkSession)
    names = [c for c in coded.columns if c != "decoded"]
    packed = _pack(coded, ids, names)
    row_type = packed.schema["row"].dataType.simpleString()

    def read(batches):
        pieces = load(path)
        for batch in batches:
            lists = batch["x"]
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, lengths = pieces.decode(flat, counts)
            ends, raw = np.cumsum(lengths), data.tobytes()
            texts = [raw[e - n : e].decode("utf-8", "replace") if ok else None for e, n, ok in zip(ends, lengths, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], ["row", "decoded"])

    return packed.mapInArrow(read, f"row {row_type}, decoded string").select("row.*", "decoded")


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, keep=["doc_id"]).select("doc_id", "ids", "n_pieces", "round_trip")
