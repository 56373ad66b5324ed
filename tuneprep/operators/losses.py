"""Token cross-entropy and its summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.binding import let
from tuneprep.functions.tokens import IGNORE


BAD_TARGET = "bad_target"


class LossError(ValueError):
    """A batch has a label outside its logits, no target token or a loss that is not finite."""


def target_fault(logits: Column, label: Column) -> Column:
    """``bad_target`` for a null label, or one outside the logits that is not the ignored one; else null."""
    inside = label.between(0, F.size(logits) - 1) | (label == IGNORE)
    return F.when(~F.coalesce(inside, F.lit(False)), F.lit(BAD_TARGET))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Log-sum-exp of the logits minus the logit of the label.

    Null if the label is ignored, and if it is no place in the logits; ``target_fault``
    tells the second case, which is an error, from the first.
    """

    def log_sum(top: Column) -> Column:
        total = F.aggregate(
            logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top)
        )
        return top + F.log(total)

    target = F.get(logits, label).cast("double")
    return F.when(label != IGNORE, let(F.array_max(logits).cast("double"), log_sum) - target)


def causal_pairs(
    tokens: DataFrame,
    example: Sequence[str],
    position: str = "position",
    logits: str = "logits",
    label: str = "label",
) -> DataFrame:
    """Pair the logits at position t with the label at t + 1 of the same example.

    An equi join on (example, position), which is unique, so an example of any
    length is spread over the tasks. The last position of an example has no pair.
    Logits of a large vocabulary would all pass this join: where an example's labels are
    one array, carry it with each row and use ``next_labels``, which moves nothing.
    """
    targets = tokens.select(*example, (F.col(position) - 1).alias(position), label)
    return tokens.select(*example, position, logits).join(targets, [*example, position])


def next_label(labels: Column, position: Column) -> Column:
    """The label that the logits at a position predict, from the labels of the example; null at the end."""
    return F.get(labels, position.cast("int") + 1)


def next_labels(
    tokens: DataFrame, labels: str = "labels", position: str = "position", label: str = "label"
) -> DataFrame:
    """``causal_pairs`` of rows that carry the labels of their example; a projection, nothing is moved.

    ``labels`` is replaced by the label to predict; the last position of an example has none and is left out.
    """
    paired = tokens.where(F.col(position) + 1 < F.size(labels))
    return paired.withColumn(label, next_label(F.col(labels), F.col(position))).drop(
        *([labels] if labels != label else [])
    )


def batch_losses(
    losses: DataFrame, batch_col: str = "batch_id", loss: str = "loss", fault: str | None = None
) -> DataFrame:
    """Mean loss and target tokens per batch, and the fault of a batch.

    ``fault`` names a column with what ``target_fault`` found. Such a row is a target: the
    batch is at fault, and its mean is null, rather than a mean of the others.
    """
    bad = F.col(fault).isNotNull() if fault else F.lit(False)
    per_batch = losses.groupBy(batch_col).agg(
        F.count_if(bad).alias("_bad"),
        F.avg(loss).alias("_mean"),
        F.count_if(bad | F.col(loss).isNotNull()).alias("target_tokens"),
    )
    per_batch = per_batch.withColumn("batch_loss", F.when(F.col("_bad") == 0, F.col("_mean")))
    finite = ~(F.isnan("batch_loss") | (F.abs("batch_loss") == float("inf")))
    found = (
        F.when(F.col("_bad") > 0, F.lit(BAD_TARGET))
        .when(F.col("target_tokens") == 0, F.lit("no_target"))
        .when(~finite, F.lit("not_finite"))
    )
    return per_batch.select(batch_col, "batch_loss", "target_tokens", found.alias("fault"))


def require_losses(per_batch: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Raise if a batch has a label outside its logits, no target token or no finite loss."""
    shown = per_batch.where(F.col("fault").isNotNull()).take(5)
    if shown:
        raise LossError(f"{[(r[batch_col], r['fault']) for r in shown]}")
    return per_batch.drop("fault")


def loss_summary(per_batch: DataFrame, reported: str | None = None) -> DataFrame:
    """Mean of the batch means, the token-weighted mean and the number of tokens.

    ``reported`` names a column with the loss the model itself gave per batch.
    """
    tokens = F.sum("target_tokens")
    extra = [F.avg(reported).alias("model_reported_val_loss")] if reported else []
    return per_batch.agg(
        F.avg("batch_loss").alias("val_loss"),
        (F.sum(F.col("batch_loss") * F.col("target_tokens")) / F.nullif(tokens, F.lit(0))).alias(
            "token_loss"
        ),
        F.coalesce(tokens, F.lit(0)).alias("valid_target_tokens"),
        F.count(F.lit(1)).alias("n_batches"),
        *extra,
    )
