"""From checked samples to conversations, token examples and padded batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.chat import ChatTemplate, conversation, render
from tuneprep.functions.tokens import NO_TARGET, boundary, mask_prompt, word_ids
from tuneprep.operators.batches import collate_ids, require_batches
from tuneprep.operators.splits import assign_batches, shuffled
from tuneprep.session import materialise


def generation_rows(
    checked: DataFrame, template: ChatTemplate = ChatTemplate(), keep: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """What the model is asked: ``prompt_text``, which never holds the answer."""
    prompt = render(conversation(F.col("crop")), template, open_turn=True)
    return checked.select(*keep, "disease", "crop", "label_id", prompt.alias("prompt_text"))


def training_rows(
    checked: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    keep: Sequence[str] = ("sample_id",),
    tokenise: Callable[[Column], Column] = word_ids,
    image_tokens: Column | None = None,
    image_id: int = 0,
) -> DataFrame:
    """Token examples: ids, attention mask, and labels that ignore the prompt.

    ``image_tokens`` is the number of tokens the image adds at the start, with id
    ``image_id``. ``reason`` is ``no_target`` where the mask leaves nothing.
    """
    prompt = render(conversation(F.col("crop")), template, open_turn=True)
    full = render(conversation(F.col("crop"), F.col("disease")), template)
    visual = F.lit(0) if image_tokens is None else image_tokens
    tokens = checked.select(
        *keep,
        "disease",
        "crop",
        "label_id",
        tokenise(full).alias("_text_ids"),
        F.size(tokenise(prompt)).alias("prompt_length"),
        F.array_repeat(F.lit(image_id), visual.cast("int")).alias("_image_ids"),
    )
    ids = tokens.withColumn("input_ids", F.concat("_image_ids", "_text_ids"))
    edge = boundary(F.size("input_ids"), F.size("_text_ids"), F.col("prompt_length"))
    return (
        ids.withColumn("boundary", edge)
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
        .withColumn("labels", mask_prompt(F.col("input_ids"), F.col("boundary")))
        .withColumn("reason", F.when(F.col("boundary") >= F.size("input_ids"), F.lit(NO_TARGET)))
        .drop("_text_ids", "_image_ids")
    )


class NoTargetError(ValueError):
    """Strict mode met examples without a token to learn."""


@dataclass(frozen=True)
class Prepared:
    """``batches`` has the padded examples, ``quarantine`` the left-out ones with their reason."""

    batches: DataFrame
    quarantine: DataFrame


def training_batches(
    checked: DataFrame,
    key: Sequence[str],
    batch_size: int,
    pad_id: int,
    seed: int = 42,
    epoch: int = 0,
    template: ChatTemplate = ChatTemplate(),
    tokenise: Callable[[Column], Column] = word_ids,
    image_tokens: Column | None = None,
    image_id: int = 0,
    strict: bool = True,
) -> Prepared:
    """Checked samples as token examples in padded batches, in the epoch's seeded order.

    Places are given to the samples before they become tokens, so the first
    shuffle moves text and the tokenising is spread evenly over the tasks. An example
    without a target is an error in strict mode, else it is quarantined; a batch
    without a valid example is always an error. The examples are written once, as ids
    and boundaries.
    """
    placed = assign_batches(shuffled(checked, key, seed, epoch), batch_size)
    examples = training_rows(
        placed, template, [*key, "batch_id"], tokenise, image_tokens, image_id
    )
    examples = materialise(examples.drop("attention_mask", "labels"), "examples")
    left_out = examples.where(F.col("reason").isNotNull())
    if strict and (shown := left_out.select(*key).take(5)):
        raise NoTargetError(f"examples without a target: {[tuple(r) for r in shown]}")
    require_batches(examples)
    return Prepared(collate_ids(examples, pad_id), left_out)
