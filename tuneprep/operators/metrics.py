"""Classification metrics from one pass over the predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MetricsError(ValueError):
    """The evaluation set cannot be scored."""


def confusion(df: DataFrame, true_col: str = "true_id", pred_col: str = "pred_id") -> DataFrame:
    """Rows per (true, predicted) pair: the only shuffle that sees the data.

    Partial aggregation leaves each task one row per pair, so a class that holds
    most of the rows costs no more than a rare one.
    """
    return df.groupBy(
        F.col(true_col).cast("int").alias("true_id"), F.col(pred_col).cast("int").alias("pred_id")
    ).agg(F.count(F.lit(1)).alias("n"))


def guard_counts(pairs: DataFrame) -> DataFrame:
    """One row: all rows, rows that lack a class, rows with a negative truth."""

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        rows_where(F.col("true_id").isNull() | F.col("pred_id").isNull()).alias("n_null"),
        rows_where(F.col("true_id") < 0).alias("n_negative"),
    )


def guard(pairs: DataFrame, classes: DataFrame | None = None) -> None:
    """Raise for an empty set, a missing value, a negative truth or no class."""
    seen = guard_counts(pairs).first()
    if not seen["n_rows"]:
        raise MetricsError("there are no rows to evaluate")
    if seen["n_null"]:
        raise MetricsError(f"{seen['n_null']} rows lack a true or a predicted class")
    if seen["n_negative"]:
        raise MetricsError(f"{seen['n_negative']} rows have a negative true class")
    if classes is not None and classes.where(F.col("label_id") >= 0).isEmpty():
        raise MetricsError("there are no valid classes")


def class_list(pairs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The classes that are scored: those given, else all that occur as truth."""
    ids = pairs.select(F.col("true_id").alias("label_id")) if classes is None else classes.select(
        F.col("label_id").cast("int").alias("label_id")
    )
    return ids.where(F.col("label_id") >= 0).distinct()


def per_class(pairs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Support, predicted and correct rows, precision, recall and F1 of every class.

    Classes without rows are kept, with zeros. A ratio with a zero denominator is 0.
    """
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("true_id").alias("label_id"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("true_id") == F.col("pred_id"), F.col("n"))
                    .otherwise(F.lit(0))
                    .alias("correct"),
                ),
                F.struct(
                    F.col("pred_id").alias("label_id"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("correct"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label_id").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "correct")]
    )
    counted = class_list(pairs, classes).join(sums, "label_id", "left").na.fill(0)
    return counted.select(
        "*",
        _ratio(F.col("correct"), F.col("predicted")).alias("precision"),
        _ratio(F.col("correct"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("correct"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def macro(classes: DataFrame) -> DataFrame:
    """Unweighted means over the classes."""
    return classes.agg(*[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")])


def micro(classes: DataFrame) -> DataFrame:
    """Ratios of the sums over the classes; a prediction outside them is no false positive."""
    return classes.agg(*_micro())


def weighted(classes: DataFrame) -> DataFrame:
    """Means weighted by support."""
    return classes.agg(*_weighted())


def _micro() -> list[Column]:
    correct, predicted, support = F.sum("correct"), F.sum("predicted"), F.sum("support")
    return [
        _ratio(correct, predicted).alias("micro_precision"),
        _ratio(correct, support).alias("micro_recall"),
        _ratio(2 * correct, predicted + support).alias("micro_f1"),
    ]


def _weighted() -> list[Column]:
    support = F.sum("support")
    return [
        _ratio(F.sum(F.col(m) * F.col("support")), support).alias(f"weighted_{m}")
        for m in ("precision", "recall", "f1")
    ]


def accuracy(pairs: DataFrame) -> DataFrame:
    """Share of rows whose prediction equals the truth; -1 counts as wrong."""
    return pairs.agg(*_accuracy())


def _accuracy() -> list[Column]:
    right = F.sum(F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(F.lit(0)))
    return [_ratio(right, F.sum("n")).alias("accuracy"), F.sum("n").alias("num_samples")]


def unknown_rate(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Number and share of answers that matched no label."""
    unknown = F.count_if(F.col(status_col) == "unknown")
    return df.agg(
        F.count(F.lit(1)).alias("num_samples"),
        unknown.alias("unknown_predictions"),
        _ratio(unknown, F.count(F.lit(1))).alias("unknown_rate"),
    )


def classification_metrics(
    pairs: DataFrame, classes: DataFrame | None = None, unknown_id: int = -1
) -> DataFrame:
    """All metrics in one row, from the pair counts of ``confusion``.

    Several aggregates read the pairs; materialise them if they come from a large
    table.
    """
    scored = per_class(pairs, classes)
    unknown = F.sum(F.when(F.col("pred_id") == unknown_id, F.col("n")).otherwise(F.lit(0)))
    overall = pairs.agg(
        *_accuracy(),
        unknown.alias("unknown_predictions"),
        _ratio(unknown, F.sum("n")).alias("unknown_rate"),
    )
    means = scored.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *_micro(),
        *_weighted(),
    )
    # Two frames of one row and different columns, put into one row.
    both = overall.unionByName(means, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
