"""Train, validation and test splits, chunk plans, seeded orders and batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tuneprep.operators.ordering import below, hash_cut, hash_rank, seeded_hash

# First and last shard of each split of a 48-shard data set.
SHARD_SPLITS = {"train": (0, 35), "val": (36, 41), "test": (42, 47)}


class SplitError(ValueError):
    """Splits overlap, or a plan cannot be made."""


def shard_split(shard: Column, ranges: Mapping[str, tuple[int, int]] = SHARD_SPLITS) -> Column:
    """The split a shard belongs to; null outside all ranges. Ranges must not overlap."""
    if not ranges:
        raise SplitError("no split ranges given")
    check_ranges(ranges)
    out = F.lit(None).cast("string")
    for name, (first, last) in ranges.items():
        out = F.when(shard.between(first, last), F.lit(name)).otherwise(out)
    return out


def check_ranges(ranges: Mapping[str, tuple[int, int]]) -> None:
    """Raise if two splits share a shard."""
    spans = sorted((first, last, name) for name, (first, last) in ranges.items())
    for (_, last, name), (first, _, other) in zip(spans, spans[1:], strict=False):
        if first <= last:
            raise SplitError(f"splits {name!r} and {other!r} share shard {first}")


def split_overlap(assigned: DataFrame, key: str, split_col: str = "split") -> DataFrame:
    """Keys that occur in more than one split, be they shards, rows or texts."""
    return (
        assigned.groupBy(key)
        .agg(F.min(split_col).alias("first_split"), F.max(split_col).alias("last_split"))
        .where(F.col("first_split") != F.col("last_split"))
    )


def chunk_plan(
    shards: DataFrame,
    shard_col: str = "shard_id",
    chunk_size: int = 2,
    max_chunks: int | None = None,
) -> DataFrame:
    """One row per shard with the 1-based chunk it is read in.

    ``shards`` has one row per shard file, so the window runs over file names.
    """
    if chunk_size < 1:
        raise SplitError("chunk_size must be at least 1")
    position = F.row_number().over(W.orderBy(shard_col)) - 1
    plan = shards.withColumn("chunk", (F.floor(position / F.lit(chunk_size)) + 1).cast("int"))
    if max_chunks is not None and max_chunks > 0:
        plan = plan.where(F.col("chunk") <= max_chunks)
    return plan


def chunk_groups(plan: DataFrame, shard_col: str = "shard_id") -> DataFrame:
    """One row per chunk with its shards in order; an array never exceeds chunk_size."""
    return plan.groupBy("chunk").agg(
        F.array_sort(F.collect_list(shard_col)).alias("shards"),
        F.count(F.lit(1)).alias("n_shards"),
    )


def remaining_chunks(plan: DataFrame, manifest: DataFrame, epoch: int) -> DataFrame:
    """The part of the plan whose chunks the manifest does not list for the epoch."""
    done = manifest.where(F.col("epoch") == epoch).select("chunk").distinct()
    return plan.join(done, "chunk", "left_anti")


def fraction_split(
    df: DataFrame,
    key: Sequence[str],
    fraction: float = 0.15,
    seed: int = 42,
    mode: str = "exact",
    names: tuple[str, str] = ("val", "train"),
) -> DataFrame:
    """Add ``split``: a seeded sample of ``int(rows * fraction)`` rows and the rest.

    ``key`` must be unique. ``exact`` finds the hash at which the sample ends and
    compares; ``approx`` compares with the fraction itself, in a single pass,
    with sizes that are right on average only.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, *key))
    if mode == "exact":
        inside = below("_h", hash_cut(hashed, "_h", fraction=fraction))
    elif mode == "approx":
        head = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint")
        inside = head < F.lit(int(fraction * 16**8))
    else:
        raise SplitError(f"mode is 'exact' or 'approx', not {mode!r}")
    return hashed.withColumn("split", F.when(inside, names[0]).otherwise(names[1])).drop("_h")


def take_seeded(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in seeded order (all rows if fewer)."""
    hashed = df.withColumn("_h", seeded_hash(seed, *key))
    return hashed.where(below("_h", hash_cut(hashed, "_h", n=n))).drop("_h")


def disjoint_samples(
    df: DataFrame, key: Sequence[str], sizes: Mapping[str, int], seed: int = 42
) -> DataFrame:
    """Seeded samples of the given sizes that share no row; other rows are left out."""
    hashed = df.withColumn("_h", seeded_hash(seed, *key))
    split, end = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        end += size
        inside = below("_h", hash_cut(hashed, "_h", n=end))
        split = F.coalesce(split, F.when(inside, F.lit(name)))
    return hashed.withColumn("split", split).drop("_h").where(F.col("split").isNotNull())


def shuffled(
    df: DataFrame, key: Sequence[str], seed: int = 42, epoch: int = 0, position: str = "position"
) -> DataFrame:
    """Add the 0-based place of each row in the epoch's seeded order."""
    hashed = df.withColumn("_h", seeded_hash(seed, *key, epoch=epoch))
    return (
        hash_rank(hashed, "_h", "_rank")
        .withColumn(position, F.col("_rank") - 1)
        .drop("_h", "_rank")
    )


def assign_batches(df: DataFrame, batch_size: int, position: str = "position") -> DataFrame:
    """Consecutive positions form a batch; the last one may be short."""
    if batch_size < 1:
        raise SplitError("batch_size must be at least 1")
    return df.withColumn("batch_id", F.floor(F.col(position) / F.lit(batch_size)))


def first_rows(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in the given order; ``None`` keeps all."""
    return df if n is None else df.orderBy(*order).limit(n)


def first_by_key(df: DataFrame, key: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows by a unique key, without moving the rows.

    Only the keys are ordered, to find the n-th one; wide rows, such as those with
    images, are then compared with it where they are.
    """
    if n is None:
        return df
    if n < 1:
        return df.limit(0)
    place = F.struct(*key)
    last = df.select(*key).orderBy(*key).limit(n).agg(F.max(place)).scalar()
    return df.where(place <= last)
