"""Figures of a run that goes on over many chunks, without looking at earlier rows again.

What is kept of a chunk is its table of pairs: how many answers of each true class were given
each predicted class, and how many of them were unknown. Such tables add up, so the figures
after a chunk are those of the sum of the tables so far, and equal the figures of all rows.
A chunk writes under its own number; done again, it replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.matching import UNKNOWN
from tuneprep.operators.metrics import classification_metrics
from tuneprep.operators.runlog import running_accuracy
from tuneprep.session import materialise
from tuneprep.sources.files import exists, names

COUNTERS = ("n_seen", "n_correct", "unknown_so_far")


def add_chunk(
    predictions: DataFrame,
    path: str,
    chunk: int,
    by: Sequence[str] = (),
    true_col: str = "true_id",
    pred_col: str = "predicted_id",
    status_col: str = "status",
) -> None:
    """Write the pair counts of a chunk. ``by`` names the runs that are counted apart."""
    counts = predictions.groupBy(
        *by, F.col(true_col).cast("int").alias("true_id"), F.col(pred_col).cast("int").alias("pred_id")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(status_col) == UNKNOWN).alias("n_unknown"),
    )
    counts.write.mode("overwrite").parquet(f"{path}/chunk={chunk}")


def _chunks(spark: SparkSession, path: str, before: int | None) -> list[int]:
    numbers = sorted(int(n.removeprefix("chunk=")) for n in names(spark, path, folders=True) if n.startswith("chunk="))
    wanted = [n for n in numbers if before is None or n < before]
    return [n for n in wanted if exists(spark, f"{path}/chunk={n}/_SUCCESS")]


def pair_counts(
    spark: SparkSession, path: str, by: Sequence[str] = (), before: int | None = None
) -> DataFrame | None:
    """``by``, ``true_id``, ``pred_id``, ``n`` and ``n_unknown`` of all chunks, or of those before a number."""
    chunks = _chunks(spark, path, before)
    if not chunks:
        return None
    read = spark.read.parquet(*[f"{path}/chunk={n}" for n in chunks])
    return read.groupBy(*by, "true_id", "pred_id").agg(F.sum("n").alias("n"), F.sum("n_unknown").alias("n_unknown"))


def counters(
    spark: SparkSession, path: str, by: Sequence[str] = (), before: int | None = None
) -> DataFrame | None:
    """``n_seen``, ``n_correct`` and ``unknown_so_far`` of each run; None before the first chunk."""
    pairs = pair_counts(spark, path, by, before)
    if pairs is None:
        return None
    hit = F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(F.lit(0))
    return pairs.groupBy(*by).agg(
        F.sum("n").alias("n_seen"), F.sum(hit).alias("n_correct"), F.sum("n_unknown").alias("unknown_so_far")
    )


def running_accuracy_of_chunk(
    predictions: DataFrame, path: str, chunk: int, by: Sequence[str], index: str = "index", **options
) -> DataFrame:
    """``running_accuracy`` of the rows of a chunk, carried on from the chunks before it; adds the chunk to them.

    One row for each run is joined to the rows, so it may be broadcast.
    """
    add_chunk(predictions, path, chunk, by)
    inside = running_accuracy(predictions, by, index, **options)
    before = counters(predictions.sparkSession, path, by, before=chunk)
    if before is None:
        return inside
    before = before.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(c).alias(f"_{c}") for c in COUNTERS])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    both = inside.join(F.broadcast(materialise(before, "counters")), same, "left")
    both = both.withColumns({c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in COUNTERS})
    both = both.withColumn("running_accuracy", F.col("n_correct") / F.col("n_seen"))
    return both.drop(*[f"_{c}" for c in (*by, *COUNTERS)])


def figures(spark: SparkSession, path: str, classes: DataFrame, before: int | None = None) -> DataFrame:
    """All metrics and the unknown rate of the answers so far, as one row."""
    pairs = pair_counts(spark, path, before=before)
    if pairs is None:
        raise ValueError(f"no chunk was counted in {path}")
    return classification_metrics(classes=classes, pairs=materialise(pairs.drop("n_unknown"), "class-pairs"))
