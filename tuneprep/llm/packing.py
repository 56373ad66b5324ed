"""Packing of tokenised documents into sequences: best fit, then swap-based local search.

Pieces are dealt at random into groups of bounded size. A group is packed in one
task: best fit over decreasing lengths, then documents are moved or exchanged one
for one or two for one between underfull bins as long as the sum of squared fills
grows, which empties bins. Bins that are full enough are final; the pieces of the
others meet in new groups in the next round. The number of rounds is fixed, so no task
holds more pieces than a group, and nothing passes the driver but counts.

Defined cases. A null or empty text has the end id alone. Repeated rows are packed
one by one. Pieces of equal length are interchangeable; a seeded hash of the row
decides. An empty table gives no rows. Special strings in a text are encoded as the
tokenizer does by default.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.session import materialise

CAPACITY = 1024
END = 2
# Pieces of a group, about.
GROUP = 8192
ROUNDS = 3
# A bin with no more room than this is final before the last round.
ROOM = 0

# Fixed value: how byte-level vocabularies of this kind cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that every Unicode version puts into the same class; other texts take the slower way.
_SETTLED = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of texts by a byte-level vocabulary file of tokenizers.

    Merging by rank, which tiktoken does several times faster, gives the same ids if
    the cut into words is the same; where that could differ, tokenizers itself runs.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        byte = _byte_characters()
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in self._special}
        self._ranked = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if _SETTLED.fullmatch(text) and not any(s in text for s in self._special):
            return self._ranked.encode_ordinary(text)
        return self._tokenizer.encode(text, add_special_tokens=False).ids


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    """(id, piece, start, length, crc) of texts; a longer document is cut so that its first piece may be shorter."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode = Encoder(path)
    for batch in batches:
        rows, out = [], []
        for row, text in enumerate(batch.column(1)):
            ids = array("I", encode(text.as_py() or ""))
            ids.append(end)
            count = len(ids)
            if sys.byteorder == "big":
                ids.byteswap()
            start, stop, piece = 0, (count - 1) % capacity + 1, 0
            while start < count:
                rows.append(row)
                out.append((piece, start, stop - start, zlib.crc32(ids[start:stop])))
                start, stop, piece = stop, stop + capacity, piece + 1
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["id", "piece", "start", "length", "crc"],
        )


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of row numbers: each piece, longest first, goes where it leaves the least room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the rooms some bin has, ascending
    bins: list[list[int]] = []
    for row in sorted(range(len(lengths)), key=lambda r: -lengths[r]):
        length = lengths[row]
        at = bisect_right(rooms, length - 1)
        if at < len(rooms):
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[number].append(row)
        else:
            room, number = capacity, len(bins)
            bins.append([row])
        room -= length
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(number)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins after exchanges between underfull bins, each of which makes the sum of squared fills larger.

    From bin a to bin b go one or two pieces of a, and none or one comes back. That
    shifts d tokens, and the sum grows exactly if fill(b) + d > fill(a). Of the pieces that hold as
    many tokens those of the emptiest bin come first, so the first ones settle whether
    any will do, and every exchange there is gets found. As the sum grows each time, the search
    ends, when no exchange is left.
    """
    fill = [sum(lengths[r] for r in b) for b in bins]
    under = {i for i, f in enumerate(fill) if f < capacity}
    # The one or two pieces of a bin that hold so many tokens together: (fill of the bin, bin, pieces), ascending.
    holders: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
    sums: list[int] = []  # the keys of holders, ascending

    def groups(i: int) -> Iterator[tuple[int, ...]]:
        rows = bins[i]
        for k, r in enumerate(rows):
            yield (r,)
            for s in rows[k + 1 :]:
                yield (r, s)

    def tokens(rows: tuple[int, ...]) -> int:
        return sum(lengths[r] for r in rows)

    def enter(i: int) -> None:
        if fill[i] < capacity:
            under.add(i)
            for g in groups(i):
                total = tokens(g)
                if total not in holders:
                    holders[total] = []
                    insort(sums, total)
                insort(holders[total], (fill[i], i, g))

    def leave(i: int) -> None:
        under.discard(i)
        for g in groups(i):
            total = tokens(g)
            place = bisect_left(holders[total], (fill[i], i, g))
            del holders[total][place]
            if not holders[total]:
                del holders[total]
                sums.pop(bisect_right(sums, total) - 1)

    def shift(b: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The bin to take from, what comes from it and what goes back, for the largest gain in b's fill."""
        room, best, most = capacity - fill[b], None, 0
        for back in [(), *((r,) for r in bins[b])]:
            given = tokens(back)
            at = bisect_right(sums, given + room) - 1
            while at >= 0 and sums[at] - given > most:
                d = sums[at] - given
                # Only entries of b itself can stand before the emptiest other bin.
                emptiest = next((h for h in holders[sums[at]] if h[1] != b), None)
                if emptiest and emptiest[0] < fill[b] + d:
                    best, most = (emptiest[1], emptiest[2], back), d
                at -= 1
            if most == room:
                break
        return best

    for i in list(under):
        enter(i)
    changed = True
    while changed:
        changed = False
        for b in sorted(under, key=lambda i: (-fill[i], i)):
            if b not in under or not bins[b]:
                continue
            while fill[b] < capacity and (found := shift(b)):
                a, take, back = found
                leave(a)
                leave(b)
                bins[a] = [r for r in bins[a] if r not in take] + list(back)
                bins[b] = [r for r in bins[b] if r not in back] + list(take)
                d = tokens(take) - tokens(back)
                fill[a] -= d
                fill[b] += d
                enter(a)
                enter(b)
                changed = True
    return [b for b in bins if b]


def pack_group(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _packer(capacity: int, room: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _packed(rows, capacity, room)


def _packed(rows: pd.DataFrame, capacity: int, room: int) -> pd.DataFrame:
    rows = rows.sort_values("row", ignore_index=True)
    lengths = rows["length"].tolist()
    bins = pack_group(lengths, capacity)
    order = [r for b in bins for r in b]
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    out = rows.iloc[order].assign(bin=number)
    out["place"] = out.groupby("bin")["length"].cumsum() - out["length"]
    out["final"] = out.groupby("bin")["length"].transform("sum") >= capacity - room
    return out[["row", "length", "group", "bin", "place", "final"]]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """documents (id, text) as rows (id, piece, start, length, crc)."""
    kind = documents.schema["id"].dataType.simpleString()
    return documents.select("id", "text").mapInArrow(
        lambda batches: _pieces(batches, tokenizer, capacity, end), f"id {kind}, piece int, start bigint, length bigint, crc bigint"
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """pieces (with a column length, at most capacity) with sequence_id and offset.

    The sequence id is the round, the group in it and the bin in the group, in one number.
    """
    rows = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    left, done = rows.where(F.col("length") < capacity).select("row", "length"), []
    schema = "row bigint, length bigint, group bigint, bin bigint, place bigint, final boolean"
    for number in range(1, rounds + 1):
        room = ROOM if number < rounds else capacity
        groups = max(1, -(-left.count() // group))
        dealt = left.withColumn("group", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)))
        packed = materialise(dealt.groupBy("group").applyInPandas(_packer(capacity, room), schema), "packed")
        done.append(
            packed.where("final").select("row", ((F.col("group") * F.lit(group * 4) + F.col("bin")) * F.lit(4) + F.lit(number)).alias("sequence_id"), F.col("place").alias("offset"))
        )
        left = packed.where("not final").select("row", "length")
        if groups == 1 and number < rounds:
            # One group has seen all that is left: its bins are as good as a further round's.
            done.append(
                packed.where("not final").select("row", ((F.col("group") * F.lit(group * 4) + F.col("bin")) * F.lit(4) + F.lit(number)).alias("sequence_id"), F.col("place").alias("offset"))
            )
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    full = rows.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row") * 4, "offset": F.lit(0).cast("bigint")})
    return full.unionByName(rows.where(F.col("length") < capacity).join(found, "row")).drop("row")
