"""Padded batches of token examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tuneprep.functions.tokens import IGNORE, left_pad


class EmptyBatchError(ValueError):
    """A batch has no valid row."""


def collate(df: DataFrame, pad_id: int, batch_col: str = "batch_id") -> DataFrame:
    """Left-pad the valid rows (``reason`` is null) of each batch to its longest row.

    Batches are given before bad rows are dropped, so a batch may come out short.
    ``labels`` is padded only where every row of the batch has it, else null.
    ``padding`` counts the cells added per row. A batch never has more rows than
    the batch size, which bounds the window.
    """
    valid = F.col("reason").isNull() if "reason" in df.columns else F.lit(True)
    batch = W.partitionBy(batch_col)
    out = df.withColumn("padded_length", F.max(F.when(valid, F.size("input_ids"))).over(batch))
    if "labels" in df.columns:
        complete = F.min(F.when(valid, F.col("labels").isNotNull())).over(batch)
        padded = left_pad(F.col("labels"), F.col("padded_length"), IGNORE)
        out = (
            out.withColumn("_complete", complete)
            .withColumn("labels", F.when(F.col("_complete"), padded))
            .drop("_complete")
        )
    # Dropped after the window: a filter below it would tokenise every row twice.
    return (
        out.where(valid)
        .withColumn("padding", F.col("padded_length") - F.size("input_ids"))
        .withColumn(
            "attention_mask", left_pad(F.col("attention_mask"), F.col("padded_length"), 0)
        )
        .withColumn("input_ids", left_pad(F.col("input_ids"), F.col("padded_length"), pad_id))
    )


def collate_ids(df: DataFrame, pad_id: int, batch_col: str = "batch_id") -> DataFrame:
    """``collate`` for examples of which ``input_ids`` and ``boundary`` say all.

    Only these pass the exchange; the attention mask and the labels, which are as long
    again, are made of them after it.
    """
    out = collate(
        df.withColumn("attention_mask", F.array().cast("array<int>")), pad_id, batch_col
    )
    size = F.col("padded_length") - F.col("padding")
    ignored = F.col("padding") + F.least(F.col("boundary"), size)
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE), ignored.cast("int")),
        F.slice("input_ids", ignored.cast("int") + 1, (F.col("padded_length") - ignored).cast("int")),
    )
    mask = F.concat(
        F.array_repeat(F.lit(0), F.col("padding").cast("int")), F.array_repeat(F.lit(1), size.cast("int"))
    )
    return out.withColumns({"attention_mask": mask, "labels": labels})


def padding_waste(collated: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Rows, padded cells and share of padding per batch."""
    cells = F.sum("padded_length")
    return collated.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("padded_length").alias("padded_length"),
        F.sum("padding").alias("padding"),
        F.when(cells > 0, F.sum("padding") / cells).otherwise(F.lit(0.0)).alias("waste"),
    )


def empty_batches(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Batches whose rows are all bad."""
    return (
        df.groupBy(batch_col)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("reason").isNull()).alias("n_valid"))
        .where(F.col("n_valid") == 0)
        .select(batch_col, "n_rows")
    )


def require_batches(df: DataFrame, batch_col: str = "batch_id") -> None:
    """Raise if a batch has no valid row."""
    shown = empty_batches(df, batch_col).orderBy(batch_col).take(5)
    if shown:
        raise EmptyBatchError(f"batches without a valid row: {[r[batch_col] for r in shown]}")
