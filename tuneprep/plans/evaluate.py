"""Score a table of answers, or run a model over samples and score what it says."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.chat import ChatTemplate, conversation, render
from tuneprep.functions.text import strip
from tuneprep.operators.inference import Predict, predict
from tuneprep.operators.joins import lookup_join
from tuneprep.operators.matching import MatchTable, match_predictions, match_table
from tuneprep.operators.metrics import classification_metrics, guard
from tuneprep.operators.splits import first_by_key
from tuneprep.operators.validation import good_rows, require_good, resolve_labels
from tuneprep.operators.vocab import require_valid
from tuneprep.session import materialise


# Share of different answers up to which equal ones are counted before they are matched.
REPEATED = 0.25


@dataclass(frozen=True)
class Evaluation:
    """``predictions`` has one row per answer, ``metrics`` one row."""

    predictions: DataFrame
    metrics: DataFrame


def score_answers(
    answers: DataFrame,
    vocab: DataFrame | MatchTable,
    row_key: Sequence[str],
    raw_col: str = "raw_output",
    longest: bool = False,
    containment: bool = True,
) -> DataFrame:
    """Match answers and look up the id of ``true_label``; an invalid vocabulary is an error."""
    table = vocab if isinstance(vocab, MatchTable) else match_table(vocab)
    truth = table.forms.select(F.col("label").alias("true_label"), F.col("label_id").alias("true_id"))
    stripped = answers.withColumn("true_label", strip(F.col("true_label")))
    known = lookup_join(stripped, truth, "true_label", "left", row_key)
    return match_predictions(known, table, raw_col, row_key, containment, longest)


def score_table(
    answers: DataFrame,
    vocab: DataFrame,
    raw_col: str = "raw_output",
    longest: bool = False,
    containment: bool = True,
) -> DataFrame:
    """The metrics of a table of ``true_label`` and raw answers, as one row.

    Which rows the answers came from does not matter to the figures. The vocabulary is
    written, checked and measured once, for the true labels, the answers and the classes.
    """
    table = match_table(vocab.select("label", "label_id"))
    grouped = _distinct_answers(answers.withColumnRenamed(raw_col, "raw_output"), "true_label")
    scored = score_answers(grouped, table, ["true_label", "raw_output"], "raw_output", longest, containment)
    return _metrics(scored, table.forms.select("label", "label_id"))


def _distinct_answers(answers: DataFrame, truth: str) -> DataFrame:
    """Answers with ``n``, the rows that each stands for.

    Where most answers repeat, equal ones to equal labels are counted in the map tasks
    and the text work and all joins see each pair once. Where most differ, grouping
    would only move all text, so every row stands for itself. The share is estimated
    from hashes; it decides about the plan, not about the result.
    """
    pairs = answers.select(truth, "raw_output")
    seen = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(truth, "raw_output")).alias("kinds")
    ).first()
    if seen["kinds"] > REPEATED * seen["n"]:
        return pairs.withColumn("n", F.lit(1).cast("bigint"))
    return pairs.groupBy(truth, "raw_output").agg(F.count(F.lit(1)).alias("n"))


def _metrics(scored: DataFrame, vocab: DataFrame) -> DataFrame:
    """Metrics of matched answers that stand for ``n`` rows each."""
    pairs = materialise(
        scored.groupBy("true_id", F.col("predicted_id").alias("pred_id")).agg(F.sum("n").alias("n")),
        "class-pairs",
    )
    guard(pairs, vocab)
    return classification_metrics(classes=vocab, pairs=pairs)


def evaluate(
    samples: DataFrame,
    vocab: DataFrame,
    make_model: Callable[[], Predict],
    inputs: Sequence[str],
    row_key: Sequence[str] = ("sample_id",),
    max_samples: int | None = None,
    strict: bool = True,
    batch_size: int = 64,
    longest: bool = False,
    containment: bool = True,
    index: str | None = None,
    template: ChatTemplate = ChatTemplate(),
) -> Evaluation:
    """Check samples, ask the model, match its answers and score them.

    The model sees only ``inputs``, columns of the samples or the ``prompt_text``
    made here; the true label must not be among them. In
    strict mode a bad row is an error, else it is left out. ``max_samples`` takes the
    first samples by ``index`` (the column that ``with_index`` adds) or else by
    ``row_key``, before they are checked: a bad row among them counts, one after them
    does not. The answers, the costly part, are written to the shared folder once.
    ``predictions`` keeps ``row_key`` and ``index``.
    """
    if {"disease", "label_id", "true_label"} & set(inputs):
        raise ValueError("the model must not see the answer")
    vocab = require_valid(materialise(vocab.select("label", "label_id"), "vocab"))
    kept = list(dict.fromkeys([*row_key, *([index] if index else [])]))
    samples = first_by_key(samples, [index] if index else row_key, max_samples)
    checked = resolve_labels(samples, vocab, row_key)
    rows = require_good(checked) if strict else good_rows(checked)
    prompt = render(conversation(F.col("crop")), template, open_turn=True)
    asked = predict(
        rows.withColumn("prompt_text", prompt), make_model, inputs,
        batch_size=batch_size,
    )
    answers = materialise(
        asked.select(
            *kept,
            F.col("disease").alias("true_label"),
            F.col("label_id").alias("true_id"),
            "raw_output",
        ),
        "answers",
    )
    table = match_table(vocab)
    # The costly part is written; pairs are counted and matched from it.
    predictions = match_predictions(
        answers, table, "raw_output", row_key, containment, longest
    ).withColumn("correct", F.col("true_id") == F.col("predicted_id"))
    grouped = _distinct_answers(answers, "true_id")
    matched = match_predictions(
        grouped, table, "raw_output", ["true_id", "raw_output"], containment, longest
    )
    return Evaluation(predictions, _metrics(matched, vocab))
