"""Vector codes by codebooks of parts; nearest entries are found on a trie of the distinct parts.

A vector is cut into equal parts of integers, and each part is replaced by the number of
the nearest entry in the codebook of its place. Codebooks are fitted by rounds of
assignment and means, in whole numbers, so the result is the same whatever the order of
rows and tasks.

Equal parts are counted first, and each round works on the distinct ones. In
lexicographic order they are the leaves of a trie whose levels are the dimensions. A
node holds the distances of its prefix to all entries, made from those of its parent by
one dimension, so parts with a common prefix share that sum. The trie is walked depth
first; below a node with few leaves its levels are made as arrays. Leaves
take the nearest entry and add themselves to it, as often as they occur.

Defined cases. Vectors that are null, empty, hold null or non-finite components, have a
length that is no multiple of the number of parts, or another length than the vector with
the smallest id, get no row. The first entries are the parts of the vectors with
the smallest ids (null ids last, then by components); with fewer vectors, codebooks have
fewer entries. Without vectors there are no rows. Of equally near entries the first is taken.
A component so large that a sum of squares could leave 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tuneprep.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Below a node with at most so many leaves the trie is walked level by level.
LEAVES = 4096
# Rows whose vectors are encoded together.
ROWS = 4096

_SUMS = "part int, entry int, place int, total bigint"


def components(vector: str, scale: int = SCALE) -> F.Column:
    """floor(scale * x) of each component as int; an error beyond the range in which squares can be summed."""
    value = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    # (2 * bound)**2 * size stays below 2**62.
    bound = F.least(F.lit(float(1 << 30)), F.lit(float(1 << 30)) / F.sqrt(F.size(vector)))
    large = F.raise_error(F.lit("a vector component is too large to be coded")).cast("int")
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * F.lit(float(scale))) >= bound, large).otherwise(value(x).cast("int")))


def usable(vector: str, parts: int = PARTS) -> F.Column:
    """Whether a vector has components, all finite, in a number that can be cut into equal parts."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & (F.pmod(F.size(vector), F.lit(parts)) == 0) & F.forall(vector, finite), F.lit(False))


def nearest(values: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry to each part and its squared distance. values: distinct parts in lexicographic order."""
    count, width = values.shape
    index, distance = np.zeros(count, np.int64), np.zeros(count, np.int64)
    stack = [(0, count, 0, np.zeros(len(entries), np.int64))] if count else []
    while stack:
        begin, end, depth, sums = stack.pop()
        if depth < width and end - begin > leaves:
            column = values[begin:end, depth]
            starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
            below = sums + (column[starts, None] - entries[:, depth]) ** 2
            ends = np.append(starts[1:], end - begin)
            stack += [(begin + b, begin + e, depth + 1, s) for b, e, s in zip(starts.tolist(), ends.tolist(), below, strict=True)][::-1]
            continue
        level, node = sums[None], np.zeros(end - begin, np.int64)
        for d in range(depth, width):
            column = values[begin:end, d]
            first = np.concatenate([[True], (column[1:] != column[:-1]) | (node[1:] != node[:-1])])
            starts = np.flatnonzero(first)
            level = level[node[starts]] + (column[starts, None] - entries[:, d]) ** 2
            node = np.cumsum(first) - 1
        best = level.argmin(axis=1)
        index[begin:end] = best[node]
        distance[begin:end] = level[np.arange(len(best)), best][node]
    return index, distance


def _lists(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and the place of each row among them."""
    order = np.lexsort(values.T[::-1])
    ordered = values[order]
    first = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    place = np.zeros(len(values), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def _sums(batches: Iterator[pa.RecordBatch], codebooks: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each part, entry and place inside the part the weighted sum of the parts assigned; the count at place -1."""
    width = codebooks[0].shape[1]
    total = np.zeros((len(codebooks), len(codebooks[0]), width + 1), object)
    for batch in batches:
        part, values, times = batch.column(0).to_numpy(), _lists(batch.column(1), width), batch.column(2).to_numpy()
        for p in np.unique(part):
            mine = part == p
            # Two files read one after the other need not be in order.
            order = np.lexsort(values[mine].T[::-1])
            leaf, weight = values[mine][order], times[mine][order]
            index, _ = nearest(leaf, codebooks[p])
            added = np.zeros((len(codebooks[p]), width + 1), np.int64)
            np.add.at(added, index, np.concatenate([weight[:, None], leaf * weight[:, None]], axis=1))
            total[p] += added
    p, e, j = np.nonzero(np.broadcast_to(total[:, :, :1] != 0, total.shape))
    yield pa.RecordBatch.from_arrays(
        [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(j - 1, pa.int32()), pa.array(total[p, e, j].tolist(), pa.int64())],
        ["part", "entry", "place", "total"],
    )


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one (entries, width) array for each part. vectors: id, values (of one length)."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "values").limit(entries).collect()
    if not first:
        return []
    width = len(first[0]["values"]) // parts
    codebooks = [np.array([r["values"][p * width : (p + 1) * width] for r in first], np.int64) for p in range(parts)]
    if not rounds:
        return codebooks
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("values", p * width + 1, width))
    counted = vectors.select(F.posexplode(cut).alias("part", "values")).groupBy("part", "values").agg(F.count(F.lit(1)).alias("times"))
    # Neighbours in the order of the trie share a task, and so their prefixes.
    distinct = materialise(counted.repartitionByRange("part", "values").sortWithinPartitions("part", "values"), "parts")
    for _ in range(rounds):
        sums = distinct.mapInArrow(lambda batches, books=codebooks: _sums(batches, books), _SUMS)
        # At most parts * entries * (width + 1) rows, whatever the number of vectors.
        rows = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        found = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in rows}
        for p, e in {key[:2] for key in found}:
            codebooks[p][e] = [found[p, e, j] // found[p, e, -1] for j in range(width)]
    return codebooks


def _coded(batches: Iterator[pa.RecordBatch], values: int, codebooks: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    width = codebooks[0].shape[1]
    for whole in batches:
        for start in range(0, len(whole), ROWS):
            batch = whole.slice(start, ROWS)
            number = _lists(batch.column(values), len(codebooks) * width)
            code, error = np.zeros((len(batch), len(codebooks)), np.uint8), np.zeros(len(batch), np.int64)
            for p, book in enumerate(codebooks):
                leaf, place = _distinct(number[:, p * width : (p + 1) * width])
                index, distance = nearest(leaf, book)
                code[:, p] = index[place]
                error += distance[place]
            text = code.tobytes().hex()
            size = 2 * len(codebooks)
            codes = [text[i : i + size] for i in range(0, len(text), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.string()), pa.array(error)], [*batch.schema.names, "code", "error"])


def encode(vectors: DataFrame, codebooks: Sequence[np.ndarray]) -> DataFrame:
    """vectors with code, two hex digits for each part, and error, the squared distance to the coded vector."""
    vectors = vectors.drop("code", "error")
    schema = StructType([*vectors.schema.fields, StructField("code", StringType()), StructField("error", LongType())])
    if not codebooks:
        return vectors.sparkSession.createDataFrame([], schema)
    values = vectors.columns.index("values")
    return vectors.mapInArrow(lambda batches: _coded(batches, values, codebooks), schema)


def integers(rows: DataFrame, vector: str = "vector", key: str = "id", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """The rows whose vector can be coded, with its components as whole numbers in values instead of the vector."""
    sound = rows.where(usable(vector, parts))
    smallest = sound.select(key, F.size(vector).alias("size")).orderBy(F.col(key).asc_nulls_last(), "size").limit(1).collect()
    size = smallest[0]["size"] if smallest else 0
    others = [c for c in rows.columns if c not in (vector, "values")]
    return sound.where(F.size(vector) == size).select(*others, components(vector, scale).alias("values"))


def decode(codes: Sequence[str], codebooks: Sequence[np.ndarray]) -> np.ndarray:
    """The coded vectors, one row each."""
    index = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), len(codebooks))
    return np.concatenate([book[index[:, p]] for p, book in enumerate(codebooks)], axis=1)
