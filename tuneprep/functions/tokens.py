"""Token arrays: default tokeniser, prompt mask, padding and slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneprep.functions.text import WHITESPACE_CLASS, strip

# Fixed value: labels with this id do not count in the loss.
IGNORE = -100
NO_TARGET = "no_target"


def split_words(text: Column) -> Column:
    """Words between whitespace; a blank text has none."""
    words = F.split(strip(text), WHITESPACE_CLASS + "+")
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(words)


def word_ids(text: Column, size: int = 16**7) -> Column:
    """Default tokeniser: one id per word, from a hash of the word.

    It needs no vocabulary file. A real tokeniser is plugged in with
    ``operators.inference.tokenise``.
    """
    return F.transform(
        split_words(text),
        lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"), F.lit(size)),
    )


def boundary(all_len: Column, text_len: Column, prompt_len: Column) -> Column:
    """How many leading tokens belong to the prompt.

    The processed ids are longer than the text's own tokens by the image tokens.
    """
    visual = F.greatest(F.lit(0), all_len - text_len)
    return F.greatest(F.lit(0), F.least(visual + prompt_len, all_len))


def mask_prompt(ids: Column, prompt: Column) -> Column:
    """The ids as labels, with the first ``prompt`` ones ignored."""
    masked = F.least(prompt, F.size(ids)).cast("int")
    return F.concat(F.array_repeat(F.lit(IGNORE), masked), completion(ids, prompt))


def target_count(labels: Column) -> Column:
    """Number of labels that count in the loss."""
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def target_fault(labels: Column) -> Column:
    """``no_target`` when the mask leaves nothing to learn; null otherwise."""
    return F.when(target_count(labels) <= 0, F.lit(NO_TARGET))


def left_pad(values: Column, length: Column, fill: Column | int) -> Column:
    """Values moved to the right end of an array of the given length."""
    fill = F.lit(fill) if isinstance(fill, int) else fill
    gap = F.greatest(F.lit(0), (length - F.size(values)).cast("int"))
    return F.concat(F.array_repeat(fill, gap), values)


def completion(ids: Column, prompt_len: Column) -> Column:
    """The tokens after the prompt."""
    return F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))


def shift_pairs(values: Column, labels: Column) -> Column:
    """Pair what stands at t with the label at t + 1, inside one example."""
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(values, F.lit(1), n).alias("value"), F.slice(labels, F.lit(2), n).alias("label")
    )
