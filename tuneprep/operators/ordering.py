"""Global order without a global sort in one task: ranks, cuts and running values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Leading hex digits of the hash that make a bucket: 16**4 = 65,536 buckets. The
# bucket table never has more rows than that, whatever the data. Use 5 digits from
# some 10**11 rows on.
BUCKET_DIGITS = 4
ROWS_PER_BUCKET = 100_000


def seeded_hash(seed: int, *key: str, epoch: int | None = None) -> Column:
    """The hash text that orders rows for a seed (and, if given, an epoch).

    ``key`` must identify a row; several columns are joined by the unit separator.
    The same seed always gives the same order.
    """
    start = f"{seed}:" if epoch is None else f"{seed}:{epoch}:"
    parts = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in key])
    return F.md5(F.concat(F.lit(start), parts))


def _buckets(df: DataFrame, hash_col: str, digits: int) -> DataFrame:
    """Rows per bucket, rows in all buckets before it, and the total."""
    counts = df.groupBy(F.substring(hash_col, 1, digits).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    # One task, over at most 16**digits rows.
    order = W.orderBy("_bucket")
    return counts.select(
        "_bucket",
        "_rows",
        (F.sum("_rows").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_rows")).alias(
            "_before"
        ),
        F.sum("_rows").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(
            "_total"
        ),
    )


def hash_rank(
    df: DataFrame, hash_col: str, rank_col: str = "rank", digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Exact 1-based rank of every row in the order of ``hash_col``.

    A hash spreads unique keys evenly over its leading digits, so each window
    partition holds one bucket and the offsets come from the small bucket table.
    """
    buckets = _buckets(df, hash_col, digits).select("_bucket", "_before")
    inside = W.partitionBy("_bucket").orderBy(hash_col)
    return (
        df.withColumn("_bucket", F.substring(hash_col, 1, digits))
        .withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(buckets), "_bucket")
        .withColumn(rank_col, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def hash_cut(
    df: DataFrame,
    hash_col: str,
    n: int | None = None,
    fraction: float | None = None,
    digits: int = BUCKET_DIGITS,
) -> Column:
    """The hash value up to which exactly ``n`` rows (or ``int(rows * fraction)``) lie.

    A scalar subquery: bucket counts find the bucket that holds the n-th row, and
    only the rows of that bucket are ordered. Comparing ``hash_col`` with the
    result splits a table of any size in one pass without moving its rows. Null
    when nothing lies below the cut.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    hashes = df.select(hash_col)
    wanted = F.least(F.lit(n).cast("bigint"), F.col("_total")) if n is not None else F.floor(
        F.col("_total") * F.lit(float(fraction))
    )
    edge = (
        _buckets(hashes, hash_col, digits)
        .withColumn("_wanted", wanted)
        .where((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_before") + F.col("_rows")))
        .select("_bucket", (F.col("_wanted") - F.col("_before")).alias("_nth"))
    )
    # The edge is one row, so it may be broadcast.
    inside = W.partitionBy("_bucket").orderBy(hash_col)
    return (
        hashes.withColumn("_bucket", F.substring(hash_col, 1, digits))
        .join(F.broadcast(edge), "_bucket")
        .withColumn("_inside", F.row_number().over(inside))
        .where(F.col("_inside") == F.col("_nth"))
        .agg(F.max(hash_col))
        .scalar()
    )


def below(hash_col: str, cut: Column) -> Column:
    """True for rows up to and including the cut; false for all if the cut is null."""
    return F.coalesce(F.col(hash_col) <= cut, F.lit(False))


def running(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    values: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Running ``sum`` or ``max`` per ``by`` group in the order of ``position``.

    ``position`` is a non-negative integer, unique in its group. A group may hold
    any share of the rows: it is cut into buckets of consecutive positions, each
    a window partition of its own, and what lies before a bucket comes from the
    table of bucket totals.
    """
    combine = {"sum": F.sum, "max": F.max}
    # Keys without null, so that the join below can use the windows' partitioning.
    bucketed = df.withColumn("_bucket", F.floor(F.col(position) / F.lit(rows_per_bucket)))
    groups = []
    for n, name in enumerate(by):
        groups.append(f"_by_{n}")
        text = F.coalesce(F.col(name).cast("string"), F.lit("\x00"))
        bucketed = bucketed.withColumn(f"_by_{n}", text)
    for name, (_, value) in values.items():
        bucketed = bucketed.withColumn(f"_value_{name}", value)
    keys = [*groups, "_bucket"]

    totals = bucketed.groupBy(*keys).agg(
        *[combine[kind](f"_value_{name}").alias(f"_total_{name}") for name, (kind, _) in values.items()]
    )
    earlier = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[
            combine[kind](f"_total_{name}").over(earlier).alias(f"_before_{name}")
            for name, (kind, _) in values.items()
        ],
    )
    last = 0 if inclusive else -1
    local = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, last)
    placed = bucketed.select(
        *df.columns,
        *keys,
        *[
            combine[kind](f"_value_{name}").over(local).alias(f"_local_{name}")
            for name, (kind, _) in values.items()
        ],
    )
    results = []
    for name, (kind, _) in values.items():
        here, before = F.col(f"_local_{name}"), F.col(f"_before_{name}")
        both = F.coalesce(before + here, here, before) if kind == "sum" else F.greatest(before, here)
        results.append(both.alias(name))
    # At most rows_per_bucket rows per key.
    return placed.join(offsets, keys).select(*df.columns, *results)
