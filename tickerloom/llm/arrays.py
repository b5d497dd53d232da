"""Text columns as numpy arrays inside Arrow tasks: pieces of batches, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tickerloom.session import bounded_batches  # noqa: F401

PIECE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

# white space of the word pattern [^\x20\x09-\x0D]+
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece hold about ``limit`` bytes; one longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a piece: where each starts and ends, and ``of``, the first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.bytes, self.offsets = buffers(texts)
        if lower:
            self.bytes = _LOWER[self.bytes]
        n = len(self.bytes)
        inside = ~_SPACE[self.bytes] if n else np.zeros(0, bool)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = self.offsets[1:-1]
        edges = edges[edges < n]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = edges[edges > 0] - 1
        last[before] = inside[before]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        powers = np.full(int(lengths.max()), _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        begin = np.zeros(len(self.bytes), np.int64)
        begin[self.starts] = self.starts
        begin = np.maximum.accumulate(begin)
        place = np.arange(len(self.bytes), dtype=np.int64) - begin
        np.minimum(place, len(powers) - 1, out=place)
        values = _BYTE[self.bytes] * powers[place]
        return mix(np.add.reduceat(values, self.starts) + lengths.astype(np.uint64))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start+1, ... of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def string_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Texts of the given byte lengths, laid one after the other."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
