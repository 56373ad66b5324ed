"""Words and shingles of Arrow text columns as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes hashed at a time; a longer word makes its piece longer.
PIECE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a one-to-one map)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    inverse = pow(int(_MULTIPLIER), -1, 1 << 64)
    out = []
    for base in (int(_MULTIPLIER), inverse):
        powers = np.full(n, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, and where each row begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about limit bytes of text, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """Cuts texts into maximal runs of word bytes, A-Z lower-cased, and hashes each run."""

    def __init__(self, word_byte: np.ndarray):
        values = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
        self._word = word_byte.copy()
        self._word[ord("A") : ord("Z") + 1] = word_byte[ord("a") : ord("z") + 1]
        self._values = np.where(self._word, values, _U(0))
        self._powers = _powers(PIECE)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word in order, and where the words of each row begin and the last end."""
        data, offsets = text_bytes(column)
        hashes, starts, begin = [], [], 0
        while begin < len(data):
            end = self._cut(data, offsets, min(begin + PIECE, len(data)))
            h, s = self._piece(data[begin:end], offsets, begin)
            hashes.append(h)
            starts.append(s)
            begin = end
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)

    def _cut(self, data: np.ndarray, offsets: np.ndarray, end: int) -> int:
        """The first place from end on where no word is cut."""
        limit = offsets[np.searchsorted(offsets, end)] if end < len(data) else end
        while end < limit:
            stop = min(end + PIECE, limit)
            gaps = np.flatnonzero(~self._word[data[end:stop]])
            if len(gaps):
                return end + int(gaps[0])
            end = stop
        return int(end)

    def _piece(self, data: np.ndarray, offsets: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
        word = self._word[data]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inside = offsets[(offsets >= begin) & (offsets < begin + len(data))] - begin
        starts[inside] = word[inside]
        before = inside[inside > 0] - 1
        ends[before] = word[before]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        up, down = self._powers if len(data) <= PIECE else _powers(len(data))
        sums = np.cumsum(self._values[data] * up[: len(data)])
        total = sums[last] - np.where(first > 0, sums[first - 1], _U(0))
        length = (last - first + 1).astype(np.uint64)
        return mix(total * down[first] + length), first + begin


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the ranges, ends included."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; the last n - 1 words begin none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    count = len(hashes) - n + 1
    out = hashes[:count].copy()
    for i in range(1, n):
        out = out * _MULTIPLIER + hashes[i : i + count]
    return mix(out + _U(n))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column from flat values and the offsets of its rows."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the numbers from its start on, count of them, one row after the other."""
    total = int(counts.sum())
    before = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - before + np.repeat(starts, counts)
