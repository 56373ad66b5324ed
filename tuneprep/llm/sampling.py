"""Bounded training samples and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tuneprep.operators.joins import fits_broadcast, lookup_join
from tuneprep.session import materialise

# Texts that a model learns from on the driver: none longer, and of each label no more bytes in all.
LONGEST, BYTES_PER_LABEL = 1 << 20, 1 << 25


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo a divisor; null ids give null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(divisor))


def sample(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """The per_label rows of each label that come first in the order of a hash of their key.

    Only labels and keys are ordered, and of these only the ones whose hash is low
    enough to be among the first, about twice as many as are wanted; so neither the
    number of rows nor their width matters. Rows that share a key are ranked after that.
    """
    narrow = rows.select(label, key)
    counts = materialise(narrow.groupBy(label).agg(F.count(F.lit(1)).alias("_count")), "label-counts")
    place = F.shiftrightunsigned(F.xxhash64(key), 1) / F.lit(float(1 << 63))
    # One row per label, broadcast when measured to be small: rows of a frequent label are filtered where they are.
    near = lookup_join(narrow, counts, label, "inner", [key]).where(place * F.col("_count") <= 2 * per_label + 100)
    order = W.partitionBy(label).orderBy(F.xxhash64(key), key)

    def first(df: DataFrame) -> DataFrame:
        return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label).drop("_rank")

    chosen = materialise(first(near).select(label, key).distinct(), "sample")
    chosen = F.broadcast(chosen) if fits_broadcast(chosen) else chosen
    return first(rows.join(chosen, [label, key], "left_semi"))


def within_bytes(
    rows: DataFrame, label: str, key: str, per_label: int, longest: int = LONGEST, in_all: int = BYTES_PER_LABEL
) -> DataFrame:
    """The rows of a sample whose texts (column text) may be sent to the driver.

    A bound on what is learned from, not on what is scored: texts of at most ``longest`` bytes, of
    each label the first ``per_label`` rows in the order of the sample, also where rows repeat a key, and of
    these as many as ``in_all`` bytes hold.
    """
    size = F.octet_length("text")
    order = W.partitionBy(label).orderBy(F.xxhash64(key), key, F.xxhash64("text"))
    first = rows.where(size <= longest).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label)
    held = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return first.withColumn("_held", held).where(F.col("_held") <= in_all).drop("_rank", "_held")
