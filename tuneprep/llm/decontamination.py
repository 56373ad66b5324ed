"""Benchmark decontamination by winnowing.

The k-gram with the smallest hash in each sliding window is a fingerprint. Texts
that share ``window`` consecutive words share one of them at the same place inside
those words, so a join on fingerprints misses no shared span. Each joined pair is
extended word by word. A fingerprint carries the words around it that a window can
reach, so the extension needs neither text again and every row has a fixed size.

Defined cases. Null or wordless texts have no words and no hits. An item of fewer
words than a window is one shorter window. Repeated rows of documents are judged
one by one; repeated items count once by their id. Rows with a null item id are no
items. Other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.llm.words import Words, byte_class, lists, ranges, shingles, slices
from tuneprep.session import materialise

WINDOW = 10
GRAM = 5
# Bits of the filter that spares documents' fingerprints which no item has; its size bounds what is collected.
FILTER_BITS = 1 << 20

WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_NO_WORD = {"document": np.uint64(0), "item": np.uint64(1)}
_FINGERPRINT = "struct<size:int,hash:bigint,place:int,words:array<bigint>>"


def _smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of width grams the place of its smallest, the last of equal ones."""
    count = len(grams) - width + 1
    least, place = grams[:count].copy(), np.arange(count)
    for i in range(1, width):
        later = grams[i : i + count]
        better = later <= least
        least = np.where(better, later, least)
        place[better] = np.flatnonzero(better) + i
    return place


def _fingerprints(hashes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints of all rows, in order, and their hashes."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = shingles(hashes, gram)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(hashes) - window + 1) + window <= ends[: len(hashes) - window + 1])
    places = np.unique(_smallest(grams, window - gram + 1)[starts])
    return places, grams[places]


def _contexts(hashes: np.ndarray, offsets: np.ndarray, places: np.ndarray, reach: tuple[int, int], none: np.uint64) -> np.ndarray:
    """The words from reach[0] before each place to reach[1] after it; none where the row has no word."""
    rows = np.searchsorted(offsets, places, side="right") - 1
    at = places[:, None] + np.arange(-reach[0], reach[1])
    inside = (at >= offsets[rows][:, None]) & (at < offsets[rows + 1][:, None])
    return np.where(inside, hashes[np.clip(at, 0, max(len(hashes) - 1, 0))], none) if len(hashes) else np.zeros((0, sum(reach)), np.uint64)


def _rows_of(offsets: np.ndarray, parts: list[tuple], window: int, gram: int) -> pa.Array:
    """One list of fingerprints for each row of the batch."""
    rows = np.concatenate([np.searchsorted(offsets, p[1], side="right") - 1 for p in parts])
    order = np.argsort(rows, kind="stable")
    size = np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts])
    place = np.concatenate([p[1] for p in parts]) - offsets[rows]
    width = np.concatenate([np.full(len(p[1]), p[3].shape[1]) for p in parts])
    flat = np.concatenate([p[3].ravel() for p in parts])
    begin = np.cumsum(width) - width
    flat = flat[ranges(begin[order], width[order])]
    columns = [
        pa.array(size[order], pa.int32()),
        pa.array(np.concatenate([p[2] for p in parts])[order].view(np.int64)),
        pa.array(place[order].astype(np.int32)),
        lists(flat.view(np.int64), np.concatenate([[0], np.cumsum(width[order])])),
    ]
    values = pa.StructArray.from_arrays(columns, ["size", "hash", "place", "words"])
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _marked(batches: Iterator[pa.RecordBatch], kind: str, window: int, gram: int, sizes: list[int], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, n_words, marks): the fingerprints, and the whole grams of the sizes that short items have.

    A window of w words has w - gram + 1 grams; the fingerprint can be the first or the last of them.
    """
    cut = Words(WORD_BYTES)
    reach = (window - gram, window)
    none = _NO_WORD[kind]
    for batch in (part for whole in batches for part in slices(whole, 1)):
        hashes, offsets = cut(batch.column(1))
        counts = np.diff(offsets)
        places, found = _fingerprints(hashes, offsets, window, gram)
        keep = slice(None) if bits is None else bits[found & np.uint64(len(bits) - 1)]
        places, found = places[keep], found[keep]
        parts = [(window, places, found, _contexts(hashes, offsets, places, reach, none))]
        ends = np.repeat(offsets[1:], counts)
        for size in sizes:
            found = shingles(hashes, size)
            whole = np.arange(len(found)) + size <= ends[: len(found)]
            if kind == "item":
                whole &= np.repeat(counts == size, counts)[: len(found)]
            if bits is not None:
                whole &= bits[found & np.uint64(len(bits) - 1)]
            places = np.flatnonzero(whole)
            parts.append((size, places, found[places], _contexts(hashes, offsets, places, (0, size), none)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), _rows_of(offsets, parts, window, gram)], ["id", "n_words", "marks"]
        )


def _mark(table: DataFrame, kind: str, window: int, gram: int, sizes: list[int], bits: np.ndarray | None = None) -> DataFrame:
    schema = f"id {table.schema['id'].dataType.simpleString()}, n_words bigint, marks array<{_FINGERPRINT}>"
    return table.select("id", "text").mapInArrow(lambda batches: _marked(batches, kind, window, gram, sizes, bits), schema)


def _bits(fingerprints: DataFrame) -> np.ndarray:
    """Which residues of a hash some item has: at most FILTER_BITS rows reach the driver."""
    residues = fingerprints.select((F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))).cast("int").alias("bit")).distinct()
    bits = np.zeros(FILTER_BITS, bool)
    bits[residues.toArrow().column(0).to_numpy()] = True
    return bits


def _run(step: int, start: int, stop: int):
    """How many words from start on, up to stop, are equal, going by step; both word arrays have stop at least."""
    places = F.sequence(F.lit(start), F.lit(stop), F.lit(step))
    equal = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct(
            F.when(s["on"] & (F.get("words", i) == F.get("item_words", i)), s["n"] + 1).otherwise(s["n"]).alias("n"),
            (s["on"] & (F.get("words", i) == F.get("item_words", i))).alias("on"),
        ),
    )
    return equal["n"]


def hits(documents: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents with their word counts, hits): one hit for each document, item and run of equal words.

    documents and items: columns id and text. documents come back as (id, n_words,
    row); a hit is (row, item_id, start, stop), the words from start on before
    stop; runs are cut at the reach of their fingerprint and may overlap.
    """
    sizes = list(range(1, window))
    items = items.where("id is not null")
    marks = materialise(
        _mark(items, "item", window, gram, sizes).select(F.col("id").alias("item_id"), F.explode("marks").alias("m")).select("item_id", "m.*"),
        "item_marks",
    )
    present = [r[0] for r in marks.where(F.col("size") < window).select("size").distinct().sort("size").collect()]
    bits = _bits(marks)
    judged = materialise(
        _mark(documents, "document", window, gram, present, bits).withColumn("row", F.monotonically_increasing_id()), "document_marks"
    )
    found = (
        judged.where(F.size("marks") > 0)
        .select("row", F.explode("marks").alias("m"))
        .select("row", "m.*")
        .join(marks.select("item_id", "size", "hash", F.col("words").alias("item_words")).distinct(), ["size", "hash"])
    )
    reach = window - gram
    left = F.when(F.col("size") < window, 0).otherwise(_run(-1, reach - 1, 0))
    right = F.when(F.col("size") < window, F.when(F.col("words") == F.col("item_words"), F.col("size")).otherwise(0)).otherwise(
        _run(1, reach, reach + window - 1)
    )
    found = (
        found.withColumns({"left": left, "right": right})
        .where("left + right >= size")
        .select("row", "item_id", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("stop"))
    )
    return judged.select("id", "n_words", "row"), materialise(found, "hits")


def contaminated(documents: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each document: id, n_words, n_hit, spans, item_ids.

    spans are the disjoint runs of hit words (start, stop), in order; item_ids are
    the items with an occurring window, as strings, sorted, each once.
    """
    judged, found = hits(documents, items, window, gram)
    spans = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "stop"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["last"]))).alias("n"),
            F.greatest(s["last"], x["stop"]).alias("last"),
        ),
    )
    by_span = found.groupBy("row", "start").agg(F.max("stop").alias("stop"))
    covered = by_span.groupBy("row").agg(
        spans["n"].cast("bigint").alias("n_hit"), F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("runs")
    )
    by_item = found.select("row", F.col("item_id").cast("string").alias("item_id")).distinct()
    named = by_item.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return (
        judged.join(covered, "row", "left")
        .join(named, "row", "left")
        .select(
            "id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("runs", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )
