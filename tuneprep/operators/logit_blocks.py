"""Token cross-entropy where the logits of a token are split over rows.

A row holds the logits of some classes of a token, from the class ``start`` on. What a block
adds to the log-sum-exp is its maximum and the sum of the exponentials below it; two
such pairs fold into one, in any order. Blocks are reduced to these two numbers and the logit of
the label where they are read, so an exchange has three numbers for each block and no logits, and no
row has as many numbers as there are classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.binding import let
from tuneprep.functions.tokens import IGNORE
from tuneprep.operators.losses import BAD_TARGET

MISSING_BLOCK = "missing_block"


def block_parts(
    blocks: DataFrame,
    key: Sequence[str],
    start: str = "start",
    logits: str = "logits",
    label: str = "label",
) -> DataFrame:
    """``key``, the label, and of each block ``top``, ``total``, ``target``, ``first`` and ``size``; no logits.

    ``total`` is the sum of exp(x - top), 0 for a block of minus infinities. ``target`` is the logit of
    the label if it lies in the block.
    """
    x = F.col(logits)
    top = F.array_max(x).cast("double")

    def below(t: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - t))
        return F.when(t == float("-inf"), F.lit(0.0)).otherwise(total)

    place = F.col(label) - F.col(start)
    inside = (place >= 0) & (place < F.size(x))
    return blocks.where(F.size(logits) > 0).select(
        *key,
        F.col(label).cast("int").alias("label"),
        top.alias("top"),
        let(top, below).alias("total"),
        F.when(inside, F.get(x, F.when(inside, place).cast("int"))).cast("double").alias("target"),
        F.col(start).cast("bigint").alias("first"),
        F.size(logits).cast("bigint").alias("size"),
    )


def fold_blocks(parts: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key``, ``label``, ``loss`` and ``fault`` of each token, from the parts of its blocks.

    The loss is null where the label is ignored or at fault: ``bad_target`` for a label that is
    null or no class, ``missing_block`` where the blocks do not cover the classes from 0 on,
    each once. A token's list has two numbers for each of its blocks.
    """
    whole = parts.groupBy(*key).agg(
        F.max("label").alias("label"),
        F.max("top").alias("_top"),
        F.collect_list(F.struct("top", "total")).alias("_parts"),
        F.max("target").alias("_target"),
        F.max(F.col("first") + F.col("size")).alias("_classes"),
        F.sum("size").alias("_covered"),
        F.min("first").alias("_first"),
        F.count_distinct("first").alias("_starts"),
        F.count(F.lit(1)).alias("_blocks"),
    )
    total = F.aggregate(
        "_parts", F.lit(0.0), lambda acc, p: acc + p["total"] * F.exp(p["top"] - F.col("_top"))
    )
    gaps = (F.col("_covered") != F.col("_classes")) | (F.col("_first") != 0) | (F.col("_starts") != F.col("_blocks"))
    known = F.col("label").between(0, F.col("_classes") - 1) | (F.col("label") == IGNORE)
    fault = F.when(gaps, F.lit(MISSING_BLOCK)).when(~F.coalesce(known, F.lit(False)), F.lit(BAD_TARGET))
    loss = F.when(fault.isNull() & (F.col("label") != IGNORE), F.col("_top") + F.log(total) - F.col("_target"))
    return whole.select(*key, "label", loss.alias("loss"), fault.alias("fault"))


def block_cross_entropy(
    blocks: DataFrame,
    key: Sequence[str],
    start: str = "start",
    logits: str = "logits",
    label: str = "label",
) -> DataFrame:
    """Loss and fault of each token from blocks that carry the label it is to predict (see ``next_label``)."""
    return fold_blocks(block_parts(blocks, key, start, logits, label), key)
