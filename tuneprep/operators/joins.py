"""Joins against lookup tables: broadcast within a measured bound, salted beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tuneprep.session import materialise

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 0.001
# Tasks that the rows without a key, which match nothing, are spread over.
NULL_SALTS = 1024


def size_columns(table: DataFrame) -> list[Column]:
    """Aggregates that measure a table: ``_rows`` and ``_bytes``."""
    size = F.octet_length(F.to_json(F.struct(*table.columns)))
    return [
        F.count(F.lit(1)).alias("_rows"),
        F.coalesce(F.sum(size), F.lit(0)).alias("_bytes"),
    ]


def within(
    measured: Row, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether a measured table may be broadcast."""
    return measured["_rows"] <= max_rows and measured["_bytes"] <= max_bytes


def fits_broadcast(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a table, in one aggregate job, against the broadcast bound."""
    return within(table.agg(*size_columns(table)).first(), max_rows, max_bytes)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str,
    how: str = "left",
    row_key: Sequence[str] = (),
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join many rows with a table that has one row per key.

    ``row_key`` names columns that tell the rows of one key apart; it spreads a
    hot key when the table is too large to broadcast.
    """
    if fits_broadcast(table, max_rows, max_bytes):
        return rows.join(F.broadcast(table), on, how)
    return salted_join(rows, table, on, how, row_key)


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    on: str,
    how: str = "left",
    row_key: Sequence[str] = (),
    hot_share: float = HOT_SHARE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join in which the rows of a hot key go to as many tasks as its share asks for.

    At most ``1 / hot_share`` keys can hold that share of the rows, and they are
    listed by a hash of the key, so the list is bounded in rows and bytes whatever the
    data and may be broadcast. Keys that share a hash are salted alike; the join itself
    compares the keys. A key gets one salt for each ``hot_share`` that it holds; only the
    table rows of hot keys are copied. Rows with a null key are spread too. The salt is a
    hash of ``row_key``, so a task that is run again gives every row the same salt. ``counts``
    (the key and ``_rows``) saves the pass that counts the rows per key, where that is known.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"salted_join supports left and inner joins, not {how!r}")
    if counts is None:
        counts = rows.where(F.col(on).isNotNull()).select(on, F.lit(1).alias("_rows"))
    by_hash = counts.groupBy(F.xxhash64(on).alias("_hash")).agg(F.sum("_rows").alias("_rows"))
    by_hash = materialise(by_hash, "key-counts")
    total = by_hash.agg(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
    share = F.lit(hot_share) * total
    hot = by_hash.where(F.col("_rows") >= share).select(
        "_hash", F.greatest(F.ceil(F.col("_rows") / share), F.lit(2)).cast("int").alias("_salts")
    )
    hot = F.broadcast(materialise(hot, "hot-keys"))
    spread = F.xxhash64(*(row_key or rows.columns))
    left = rows.withColumn("_hash", F.xxhash64(on)).join(hot, "_hash", "left").withColumn(
        "_salt",
        F.when(F.col(on).isNull(), F.pmod(spread, F.lit(NULL_SALTS)))
        .when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = (
        table.withColumn("_hash", F.xxhash64(on))
        .join(hot, "_hash", "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_hash", "_salts")
    )
    return left.drop("_hash", "_salts").join(right, [on, "_salt"], how).drop("_salt")
