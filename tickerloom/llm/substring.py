"""Substring deduplication: windows of words, dealt as super-k-mers to the bucket of their minimiser."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import arrays, exchange
from tickerloom.session import durable_table

WINDOW = 35
#: Words of a minimiser.
GRAM = 3
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _at(k: int) -> np.uint64:
    return np.uint64(0x632BE59BD9B4E019 * int(k) % 2**64)


def minimisers(words: arrays.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of the piece, and the smallest hash of the ``gram``-word runs inside it."""
    h = words.hashes()
    n = len(h)
    counts = words.counts
    starts = arrays.spans(words.of[:-1], np.maximum(counts - window + 1, 0))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for k in range(gram):
        grams[: n - k] += arrays.mix(h[k:] + _at(k))
    low, reach = arrays.mix(grams), 1
    span = window - gram + 1
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    return starts, low[starts]


def _deal(window: int, gram: int, buckets: int):
    """Documents -> packed rows: super-k-mers by the bucket of their minimiser."""

    def deal(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in arrays.pieces(batches, "text"):
            words = arrays.Words(batch["text"])
            starts, low = minimisers(words, window, gram)
            if not len(starts):
                continue
            rid = batch["rid"].to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.searchsorted(words.of, starts, "right") - 1
            new = np.ones(len(starts), bool)
            new[1:] = (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])
            head = np.flatnonzero(new)
            first, last = starts[head], starts[np.append(head[1:], len(starts)) - 1] + window - 1
            # all words of the piece with one space after each; a super-k-mer is a stretch of them
            size = words.ends - words.starts + 1
            edge = np.concatenate([[0], np.cumsum(size)])
            line = np.full(edge[-1], 0x20, np.uint8)
            line[arrays.spans(edge[:-1], size - 1)] = words.bytes[arrays.spans(words.starts, size - 1)]
            line = line.tobytes()
            strings = [line[a:b] for a, b in zip(edge[first].tolist(), (edge[last + 1] - 1).tolist(), strict=True)]
            # a string that comes again in this piece travels once; its other places go by the name of the first
            seen: dict[bytes, int] = {}
            of = np.array([seen.setdefault(s, i) for i, s in enumerate(strings)], np.int64)
            own = np.flatnonzero(of == np.arange(len(of)))
            again = np.flatnonzero(of != np.arange(len(of)))
            many = np.zeros(len(of), np.uint8)
            many[of[again]] = 1
            at = (first - words.of[text[head]]).astype(np.int32)
            doc = rid[text[head]]
            name = arrays.mix(doc.view(np.uint64) + at.astype(np.uint64) * _BASE)
            rows = []
            for bucket, (i,) in exchange.cut(exchange.bucket_of(arrays.mix(low[head[own]]), buckets), own):
                blob = squeeze.compress(b"\n".join([strings[j] for j in i.tolist()]))
                rows.append((bucket, 0, blob, doc[i].tobytes(), at[i].tobytes(), many[i].tobytes()))
            first_name = name[of[again]]
            for bucket, (s, d, a) in exchange.cut(exchange.bucket_of(first_name, buckets), first_name, doc[again], at[again]):
                rows.append((bucket, 1, s.tobytes(), d.tobytes(), a.tobytes(), None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "kind", "x", "doc", "at", "many"])

    return deal


_PACKED = "bucket int, kind int, x binary, doc binary, at binary, many binary"
_FOUND = "kind int, rid long, name long, a int, b int"


def repeated_windows(word: np.ndarray, starts: np.ndarray, window: int, twice: np.ndarray) -> np.ndarray:
    """Which windows of exact word numbers occur more than once; a window of a string marked ``twice`` counts double.

    Windows are sorted by a 64-bit hash; neighbours with equal hashes are then
    compared word by word. Where that finds a false neighbour, the windows of
    that hash are sorted by their words.
    """
    if not len(starts):
        return np.zeros(0, bool)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(word), _BASE, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(word), np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(arrays.mix(word.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    value = (sums[starts + window] - sums[starts]) * back[starts]
    order = np.argsort(value, kind="stable")
    same = np.flatnonzero(value[order][1:] == value[order][:-1])
    left, right = starts[order[same]], starts[order[same + 1]]
    equal = np.ones(len(same), bool)
    for k in range(window):
        equal &= word[left + k] == word[right + k]
    out = twice.copy()
    out[order[same[equal]]] = True
    out[order[same[equal] + 1]] = True
    for v in np.unique(value[order[same[~equal]]]):
        group = np.flatnonzero(value == v)
        _, kind, size = np.unique(word[starts[group][:, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
        out[group[size[kind.ravel()] > 1]] = True
    return out


def _count(window: int):
    """A bucket -> 0: words a to b of document rid are covered; 1: so are words a to b after the place called name; 2: document rid has such a place at word a."""

    def count(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        data, more = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
        doc, at = exchange.joined(data["doc"].to_pylist(), np.int64), exchange.joined(data["at"].to_pylist(), np.int32)
        many = exchange.joined(data["many"].to_pylist(), np.uint8).astype(bool)
        expand = zstandard.ZstdDecompressor()
        whole = np.frombuffer(b"\n".join(expand.decompress(x) for x in data["x"].to_pylist()), np.uint8)
        rows = [np.zeros(0, np.int64)] * 5
        if len(whole):
            mark = np.flatnonzero((whole == 0x20) | (whole == 0x0A))
            starts, ends = np.concatenate([[0], mark + 1]), np.append(mark, len(whole))
            joint = np.flatnonzero(whole[mark] == 0x0A) + 1  # first word of each string but the first
            edge = np.concatenate([[0], joint, [len(starts)]])
            # the gap after a word goes with it, so that one offset array serves; a line end is made a space first
            line = np.append(np.where(whole == 0x0A, 0x20, whole).astype(np.uint8), np.uint8(0x20))
            cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(line)).astype(np.int64)), pa.py_buffer(line)])
            word = cells.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            del cells, line, whole, ends
            size = np.diff(edge)
            first = arrays.spans(edge[:-1], size - window + 1)
            string = np.repeat(np.arange(len(size)), size - window + 1)
            hit = repeated_windows(word, first, window, many[string])
            first, string = first[hit], string[hit]
            # runs of covered words within a string
            new = np.ones(len(first), bool)
            new[1:] = (string[1:] != string[:-1]) | (first[1:] > first[:-1] + window)
            head = np.flatnonzero(new)
            begin = first[head] - edge[string[head]]
            end = (first[np.append(head[1:], len(first)) - 1] if len(first) else first) + window - edge[string[head]]
            own = string[head]
            name = arrays.mix(doc.view(np.uint64) + at.astype(np.uint64) * _BASE).view(np.int64)
            twice = many[own]
            rows = [
                np.repeat([0, 1], [len(own), int(twice.sum())]),
                np.concatenate([doc[own], np.zeros(int(twice.sum()), np.int64)]),
                np.concatenate([np.zeros(len(own), np.int64), name[own[twice]]]),
                np.concatenate([at[own] + begin, begin[twice]]),
                np.concatenate([at[own] + end, end[twice]]),
            ]
        s, d, a = (exchange.joined(more[c].to_pylist(), t) for c, t in (("x", np.int64), ("doc", np.int64), ("at", np.int32)))
        extra = [np.full(len(s), 2), d, s, a, a]
        kinds = [np.int32, np.int64, np.int64, np.int32, np.int32]
        return pa.table({n: pa.array(np.concatenate([x, y]).astype(t)) for n, x, y, t in zip(("kind", "rid", "name", "a", "b"), rows, extra, kinds, strict=True)})

    return count


def covered_words(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(rid, a, b): words a to b, b excluded, of the document with that rid lie in windows that start elsewhere too.

    ``docs`` has rid and text. Consecutive windows whose smallest run of ``gram``
    words is the same form a super-k-mer, which travels as one string to the
    bucket of that run; equal windows have equal smallest runs, so each bucket
    counts its windows exactly. A string that comes more than once among the
    texts of a piece travels once, so what copies send is bounded by the number
    of pieces; their other places are found again by a join on the string's name.
    """
    spark = docs.sparkSession
    arrays.bounded_batches(spark)
    buckets = exchange.bucket_count(spark)
    packed = docs.select("rid", "text").mapInArrow(_deal(window, gram, buckets), _PACKED)
    found = durable_table(packed.groupBy("bucket").applyInArrow(_count(window), _FOUND))
    there = found.where("kind = 1").select("name", "a", "b")
    also = found.where("kind = 2").select("name", "rid", F.col("a").alias("at"))
    return found.where("kind = 0").select("rid", "a", "b").union(also.join(there, "name").select("rid", F.col("at") + F.col("a"), F.col("at") + F.col("b")))


def _remove(batches):
    """Drops the covered words of each text, and gives what is left with one space between words."""
    for batch in arrays.pieces(batches, "text"):
        words = arrays.Words(batch["text"])
        keep = np.ones(len(words), bool)
        counts = words.counts
        spans = batch["spans"]
        lengths = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        for row, a, b in zip(np.repeat(np.arange(batch.num_rows), lengths), pc.struct_field(flat, "a").to_pylist(), pc.struct_field(flat, "b").to_pylist(), strict=True):
            keep[words.of[row] + a : words.of[row] + min(b, counts[row])] = False
        whole = words.bytes.tobytes()
        starts, ends = words.starts.tolist(), words.ends.tolist()
        kept, gone = [], []
        for begin, end in zip(words.of[:-1].tolist(), words.of[1:].tolist(), strict=True):
            stay = np.flatnonzero(keep[begin:end]) + begin
            kept.append(b" ".join([whole[starts[i] : ends[i]] for i in stay.tolist()]))
            gone.append(end - begin - len(stay))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(counts), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all), with n_words, n_removed and ``kept``, the text left.

    A word goes if a window of ``window`` words that covers it starts, with the
    same words, anywhere else: in another row, also one that repeats this one, or
    elsewhere in the same text. Windows are judged on the input.

    Null text: no words. Texts shorter than a window lose nothing. Empty table:
    empty result. Null doc_id is an id like any other. Columns named like the
    results are replaced. Rows are told apart by a 64-bit hash of id and text.
    """
    names = [c for c in (keep or docs.columns) if c not in ("n_words", "n_removed", "kept")]
    text = F.col("text").cast("string")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("text"), F.xxhash64("doc_id", text).alias("rid"))
    row_type = packed.schema["row"].dataType.simpleString()
    # rows alike in id and text have one rid and the same spans, told once: as many as the text has super-k-mers
    spans = covered_words(packed, window=window, gram=gram).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    marked = packed.join(spans.hint("shuffle_hash"), "rid", "left").select("row", "text", "spans")
    return marked.mapInArrow(_remove, f"row {row_type}, n_words long, n_removed long, kept string").select("row.*", "n_words", "n_removed", "kept")


def op8_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs, keep=["doc_id"]).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
