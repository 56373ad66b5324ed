"""Match free-text answers to the vocabulary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tuneprep.functions.text import normalise_label
from tuneprep.operators.bit_filter import bit_filter, may_match
from tuneprep.operators.joins import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    salted_join,
    size_columns,
    within,
)
from tuneprep.operators.vocab import VocabularyError, normalised_vocab, require_valid
from tuneprep.session import materialise

UNKNOWN_LABEL = "Unknown"
UNKNOWN_ID = -1
MATCHED = "valid_normalized"
UNKNOWN = "unknown"

# Longest label, in words, that is looked up by a chain of joins: two per word.
LOOKUP_WORDS = 4


def _priority(longest: bool) -> Column:
    """The struct whose minimum is the wanted match."""
    first = -F.length("norm") if longest else F.col("label_id")
    return F.struct(
        first.cast("bigint").alias("place"),
        F.col("label_id").cast("int").alias("label_id"),
        F.col("label").alias("label"),
    )


@dataclass(frozen=True)
class MatchTable:
    """The normalised vocabulary, written down and measured once for any number of matches."""

    forms: DataFrame
    words: int
    measured: Row


def match_table(vocab: DataFrame) -> MatchTable:
    """Normalise a valid vocabulary; raise if two labels cannot be told apart any more.

    An invalid one, such as a label with two ids, is an error here, so that all ways of
    joining give the same rows.
    """
    forms = materialise(normalised_vocab(vocab), "vocab-forms")
    require_valid(forms.select("label", "label_id"))
    measured = forms.agg(
        *size_columns(forms),
        F.max("fault").alias("fault"),
        F.max(F.size(F.split("norm", "_"))).alias("words"),
    ).first()
    if measured["fault"] is not None:
        faulty = forms.where(F.col("fault").isNotNull()).orderBy("norm", "label")
        shown = [r["label"] for r in faulty.take(4)]
        raise VocabularyError(f"labels cannot be told apart after normalising: {shown}")
    return MatchTable(forms, measured["words"] or 0, measured)


def match_predictions(
    predictions: DataFrame,
    vocab: DataFrame | MatchTable,
    raw_col: str = "raw_output",
    row_key: Sequence[str] = (),
    containment: bool = True,
    longest: bool = False,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add ``normalised``, ``predicted_label``, ``predicted_id`` and ``status``.

    An answer matches the label it equals after normalising. Else, with
    ``containment``, the first label in vocabulary order (or the longest) that is
    a run of whole words at its start or end. "a starts or ends with b" for whole
    words means that b is one of the word prefixes or suffixes of a, which makes
    the test an equi join.

    A vocabulary within the broadcast bound is looked up once per prefix and suffix
    length, in one stage without a shuffle. A larger one, or one with longer labels, is
    joined with the distinct answers and the result is joined back; of a larger one a bit
    filter of bounded size goes to the answers first.
    """
    table = vocab if isinstance(vocab, MatchTable) else match_table(vocab)
    entries = table.forms.select("norm", _priority(longest).alias("entry"))
    most = table.words if containment else 0
    small = within(table.measured, max_rows, max_bytes)
    if small and most <= LOOKUP_WORDS:
        answers = predictions.withColumn("normalised", normalise_label(F.col(raw_col)))
        matched = _by_lookup(answers, entries, most)
    else:
        keys = None if small else table.measured["_rows"]
        matched = _by_shuffle(predictions, raw_col, entries, most, row_key, keys)
    return matched.select(
        *predictions.columns,
        "normalised",
        F.coalesce("_match.label", F.lit(UNKNOWN_LABEL)).alias("predicted_label"),
        F.coalesce("_match.label_id", F.lit(UNKNOWN_ID)).alias("predicted_id"),
        F.when(F.col("_match").isNotNull(), MATCHED).otherwise(UNKNOWN).alias("status"),
    )


def _words(text: Column, count: Column) -> Column:
    """The first ``count`` words, or the last ones for a negative count."""
    return F.call_function("substring_index", text, F.lit("_"), count)


def _by_lookup(answers: DataFrame, entries: DataFrame, words: int) -> DataFrame:
    def look_up(df: DataFrame, key: Column, name: str) -> DataFrame:
        table = F.broadcast(entries.select(F.col("norm").alias("_norm"), F.col("entry").alias(name)))
        return df.join(table, key == F.col("_norm"), "left").drop("_norm")

    out = look_up(answers, F.col("normalised"), "_exact")
    rest = F.when(F.col("_exact").isNull(), F.col("normalised"))
    parts = []
    for n in range(1, words + 1):
        for name, count in ((f"_start_{n}", n), (f"_end_{n}", -n)):
            out = look_up(out, F.substring_index(rest, "_", count), name)
            parts.append(F.col(name))
    best = F.array_min(F.array(*parts)) if parts else F.lit(None)
    return out.withColumn("_match", F.coalesce(F.col("_exact"), best)).drop(
        "_exact", *[c for c in out.columns if c.startswith(("_start_", "_end_"))]
    )


def _by_shuffle(
    predictions: DataFrame,
    raw_col: str,
    entries: DataFrame,
    words: int,
    row_key: Sequence[str],
    keys: int | None,
) -> DataFrame:
    """Match the distinct answers by an equi join on their pieces.

    Entries are broadcast, or, if they are too many and ``keys`` gives their number, sent as a
    bit filter that drops most pieces that match nothing before the others are shuffled.
    """
    keyed = predictions.withColumn("_text", F.coalesce(F.col(raw_col), F.lit("")))
    # Map-side combine leaves one row per distinct answer, however often it occurs;
    # only these are normalised and matched, and their counts name the hot ones.
    counts = keyed.groupBy("_text").agg(F.count(F.lit(1)).alias("_rows"))
    texts = materialise(
        counts.withColumn("normalised", normalise_label(F.col("_text"))), "answer-texts"
    )
    lengths = F.sequence(F.lit(1), F.least(F.size(F.split("normalised", "_")), F.lit(words)))
    pieces = F.array(F.col("normalised"))
    if words:
        pieces = F.array_distinct(
            F.concat(
                pieces,
                F.transform(lengths, lambda n: _words(F.col("normalised"), n)),
                F.transform(lengths, lambda n: _words(F.col("normalised"), -n)),
            )
        )
    distinct = texts.select("normalised").where(F.col("normalised") != "").distinct()
    candidates = distinct.select("normalised", F.explode(pieces).alias("norm"))
    part = (F.col("norm") != F.col("normalised")).alias("part")
    if keys is None:
        pieces_found = candidates.join(F.broadcast(entries), "norm")
    else:
        candidates = candidates.where(may_match(F.col("norm"), bit_filter(entries, "norm", keys)))
        pieces_found = salted_join(candidates, entries, "norm", "inner", ["normalised"])
    found = (
        pieces_found.groupBy("normalised")
        .agg(F.min(F.struct(part, "entry")).alias("m"))
        .select("normalised", F.col("m.entry").alias("_match"))
    )
    matches = salted_join(texts.drop("_rows"), found, "normalised", "left", ["_text"])
    return salted_join(
        keyed, materialise(matches, "answer-matches"), "_text", "left", row_key, counts=texts
    )
