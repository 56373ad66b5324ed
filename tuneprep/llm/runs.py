"""Periodic runs of words by grouping: Lyndon roots under both orders of the words, extended into runs.

Phase one of Baier's suffix sorter groups positions by their longest Lyndon prefix. The
text starts as blocks of one word. The group of the greatest blocks is final: each chain
of copies u...u of it, behind a lower block v, is appended to v, and the block v u...u goes
to a new group just above that of v. What is left over at the end are the Lyndon factors;
on the way every position has had its longest Lyndon word. A run of exponent e shows
itself as a chain of at least e - 1 copies of its root, under the order of the words
or under the reversed one. A chain is extended to both sides by the longest common
extension of the text with itself one period further, which is shorter than the root.

A text has few words in long runs, so words that can't be in one are cut out before,
by a necessary condition: inside a run of exponent 4 every three words in a row occur three
times. Counts by hash can only be too large. What remains are exact words, not hashes.

Defined cases. A text without words, or null, has no runs and is empty when collapsed.
Words are compared byte by byte. Repeated rows are worked on one by one, and rows keep
all their columns; columns named like the two results are replaced. A text is held in
memory with about 200 bytes a word, the only bound on its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tuneprep.llm.words import mix, slices

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
# Rounds of cutting out; each one only saves work for the next.
CUTS = 3
# Bytes of text worked on together.
PIECE = 2 << 20

RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def chains(codes: np.ndarray, kinds: int, least: int) -> list[tuple[int, int, int]]:
    """(start, copies, length) of the chains of at least that many equal neighbouring Lyndon words.

    codes: ranks from 1 to kinds; 0 separates texts, and stands first and last.
    """
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=kinds + 1))
    members = [[]] + [order[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    alive = [len(m) for m in members]
    length = [0] + [1] * kinds
    # Groups in a list from the greatest to 0; the last entry stands above the greatest.
    lower, higher = [0, *range(kinds)], [*range(1, kinds + 1), 0]
    group = codes.tolist()
    left, right = list(range(-1, len(group) - 1)), list(range(1, len(group) + 1))
    found = []
    g = kinds
    while g:
        size = length[g]
        longer: dict[tuple[int, int], list[int]] = {}
        for i in members[g]:
            v = left[i]
            # Blocks that have moved up, and copies behind the first of a chain.
            if group[i] != g or group[v] == g:
                continue
            j, copies = right[i], 1
            while group[j] == g:
                j, copies = right[j], copies + 1
            if copies >= least:
                found.append((i, copies, size))
            right[v], left[j] = j, v
            if group[v]:
                longer.setdefault((copies, group[v]), []).append(v)
        members[g] = []
        for copies, old in sorted(longer, reverse=True):
            moved = longer[copies, old]
            if len(moved) == alive[old]:
                members[old] = moved
                length[old] += copies * size
                continue
            new = len(length)
            above = higher[old]
            length.append(length[old] + copies * size)
            members.append(moved)
            alive.append(len(moved))
            alive[old] -= len(moved)
            lower.append(old)
            higher.append(above)
            higher[old] = new
            lower[above] = new
            for v in moved:
                group[v] = new
        g = lower[g]
    return found


def _agreement(one: np.ndarray, two: np.ndarray) -> int:
    """How many leading items of two sequences agree."""
    at, step, limit = 0, 16, min(len(one), len(two))
    while at < limit:
        differ = np.flatnonzero(one[at : min(at + step, limit)] != two[at : min(at + step, limit)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return limit


def extend(words: np.ndarray, start: int, copies: int, period: int) -> tuple[int, int]:
    """Begin and end of the run around a chain; words differ on the two sides of a border of texts."""
    end = start + copies * period
    before = _agreement(words[:start][::-1], words[: start + period][::-1])
    return start - before, end + _agreement(words[end:], words[end - period :])


def _may_run(words: np.ndarray, part: np.ndarray, least_count: int) -> np.ndarray:
    """Which words may be in a run: all three-word sequences of a run occur least_count times in their part."""
    if len(words) < 3:
        return np.zeros(len(words), bool)
    n = len(words) - 2
    key = part[:n].astype(np.uint64) * _FACTORS[3]
    for i in range(3):
        key += words[i : i + n].astype(np.uint64) * _FACTORS[i]
    key = (mix(key) & np.uint64((1 << max(10, (4 * n).bit_length())) - 1)).astype(np.int64)
    inside = part[:n] == part[2:]
    often = inside & (np.bincount(key[inside], minlength=int(key.max()) + 1)[key] >= least_count)
    alive = np.zeros(len(words), bool)
    for i in range(3):
        alive[i : i + n] |= often
    return alive


def _segments(alive: np.ndarray, part: np.ndarray, least_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words in stretches of at least least_length words that may run, and the number of their stretch."""
    place = np.flatnonzero(alive)
    if not len(place):
        return place, place
    begins = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(part[place]) != 0)])
    stretch = np.cumsum(begins) - 1
    keep = np.bincount(stretch)[stretch] >= least_length
    return place[keep], stretch[keep]


def find_runs(words: np.ndarray, part: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(begin, end, period) of all runs of a sequence of word numbers, none across two parts, in order.

    A run has least_length words and least_exponent periods at least (3 or more, as a
    chain needs two copies), and no neighbour extends it. part: the text of each word.
    """
    if least_exponent < 3:
        raise ValueError("least_exponent must be at least 3")
    least_count = min(max(least_length, least_exponent) - 2, least_exponent - 1)
    place, stretch = _segments(np.ones(len(words), bool), part, least_length)
    for _ in range(CUTS if least_count > 1 else 0):
        may = _may_run(words[place], stretch, least_count)
        if may.all():
            break
        kept, stretch = _segments(may, stretch, least_length)
        place = place[kept]
    if not len(place):
        return []
    # One separator before each stretch and one at the end.
    border = np.concatenate([[True], np.diff(stretch) != 0])
    at = np.arange(len(place)) + np.cumsum(border)
    ranks = np.unique(words[place], return_inverse=True)[1] + 1
    kinds = int(ranks.max())
    codes = np.zeros(len(place) + int(border.sum()) + 1, np.int64)
    codes[at] = ranks
    origin = np.zeros(len(codes), np.int64)
    origin[at] = place
    # For extension every separator is a word of its own.
    apart = np.where(codes > 0, codes, -1 - np.arange(len(codes)))
    out = set()
    for order in (codes, np.where(codes > 0, kinds + 1 - codes, 0)):
        for start, copies, period in chains(order, kinds, least_exponent - 1):
            begin, end = extend(apart, start, copies, period)
            if end - begin >= max(least_length, least_exponent * period):
                out.add((int(origin[begin]), int(origin[end - 1]) + 1, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _texts(texts: list[bytes], least_length: int, least_exponent: int) -> Iterator[tuple[list[dict], bytes]]:
    """The runs and the collapsed form of each text."""
    # bytes.split cuts at just the bytes 0x20 and 0x09 to 0x0D.
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    flat = np.empty(offsets[-1], object)
    flat[:] = [w for ws in words for w in ws]
    numbers = pd.factorize(flat)[0].astype(np.int64)
    found = find_runs(numbers, np.repeat(np.arange(len(texts)), counts), least_length, least_exponent)
    owner = np.searchsorted(offsets, [r[0] for r in found], side="right") - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, (begin, end, period) in zip(owner.tolist(), found, strict=True):
        runs[text].append((begin - int(offsets[text]), end - int(offsets[text]), period))
    for ws, rs in zip(words, runs, strict=True):
        if rs:
            # How many runs say that a word goes, as a sum of steps.
            steps = np.zeros(len(ws) + 1, np.int64)
            for begin, end, period in rs:
                steps[begin + period] += 1
                steps[end] -= 1
            ws = compress(ws, (np.cumsum(steps[:-1]) == 0).tolist())
        yield [{"start": b, "length": e - b, "period": p} for b, e, p in rs], b" ".join(ws)


_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def runs(rows: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """rows with ``runs``, those of the column text by start and period, and ``collapsed``.

    ``collapsed`` is the text without the words that follow the first period of a run,
    its words joined by single spaces.
    """
    rows = rows.drop("runs", "collapsed")
    text = rows.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, PIECE):
                texts = batch.column(text).cast(pa.large_binary()).fill_null(b"").to_pylist()
                found, collapsed = zip(*_texts(texts, least_length, least_exponent), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found, _RUNS), pa.array(collapsed, pa.string())], [*batch.schema.names, "runs", "collapsed"]
                )

    schema = StructType([*rows.schema.fields, StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    return rows.mapInArrow(work, schema)
