"""Row checks: every row gets its label id, or the reason why it has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.text import strip
from tuneprep.operators.joins import lookup_join

MISSING_LABEL = "missing_label"
EMPTY_LABEL = "empty_label"
BAD_ID = "bad_id"
NEGATIVE_ID = "negative_id"
ID_MISMATCH = "id_mismatch"
UNKNOWN_LABEL = "unknown_label"


class BadRowsError(ValueError):
    """Strict mode met rows that fail a check."""


def label_fault(label: Column) -> Column:
    """Why a label cannot be used; null if it can."""
    return F.when(label.isNull(), F.lit(MISSING_LABEL)).when(
        strip(label.cast("string")) == "", F.lit(EMPTY_LABEL)
    )


def clean_crop(crop: Column) -> Column:
    """The stripped crop name, empty where there is none."""
    return F.coalesce(strip(crop.cast("string")), F.lit(""))


def resolve_labels(
    samples: DataFrame, vocab: DataFrame, row_key: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Check ``disease`` and ``label_id`` of every row against the vocabulary.

    Adds ``reason`` (null for good rows) and replaces ``disease``, ``crop`` and
    ``label_id`` by their cleaned values. An id that is no whole number of 32 bits is
    ``bad_id``. A given id is kept if its label is not in
    the vocabulary; ``id_source`` tells such rows apart (``given``, ``checked``,
    ``vocabulary``).
    """
    table = vocab.select(
        F.col("label").alias("_label"), F.col("label_id").cast("bigint").alias("_vocab_id")
    )
    checked = samples.withColumn("_label", strip(F.col("disease").cast("string")))
    joined = lookup_join(checked, table, "_label", "left", row_key)
    given, known = F.expr("try_cast(label_id as int)"), F.col("_vocab_id")
    has_id = F.col("label_id").isNotNull()
    reason = (
        F.coalesce(
            label_fault(F.col("disease")),
            F.when(has_id & given.isNull(), F.lit(BAD_ID)),
            F.when(has_id & (given < 0), F.lit(NEGATIVE_ID)),
            F.when(has_id & known.isNotNull() & (known != given), F.lit(ID_MISMATCH)),
            F.when(~has_id & known.isNull(), F.lit(UNKNOWN_LABEL)),
        )
    )
    source = (
        F.when(~has_id, F.lit("vocabulary"))
        .when(known.isNull(), F.lit("given"))
        .otherwise(F.lit("checked"))
    )
    others = [c for c in samples.columns if c not in ("disease", "crop", "label_id")]
    crop = F.col("crop") if "crop" in samples.columns else F.lit(None).cast("string")
    out = joined.select(
        *others,
        F.col("_label").alias("disease"),
        clean_crop(crop).alias("crop"),
        F.when(has_id, given).otherwise(known).alias("_id"),
        source.alias("_source"),
        reason.alias("reason"),
    )
    good = F.col("reason").isNull()
    return out.select(
        *others,
        "disease",
        "crop",
        F.when(good, F.col("_id")).cast("int").alias("label_id"),
        F.when(good, F.col("_source")).alias("id_source"),
        "reason",
    )


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull())


def reason_counts(checked: DataFrame) -> DataFrame:
    """Rows per reason; ``ok`` counts the good ones."""
    return checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def require_good(checked: DataFrame, show: int = 20) -> DataFrame:
    """Strict mode: raise if any row is bad, naming the counts and first labels."""
    counts = {r["reason"]: r["n_rows"] for r in reason_counts(checked).collect()}
    counts.pop("ok", None)
    if counts:
        first = [r["disease"] for r in quarantine(checked).select("disease").take(show)]
        raise BadRowsError(f"bad rows {counts}, labels of some: {first}")
    return good_rows(checked)


def debug_rows(predictions: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` predictions with truth, raw answer, match and status."""
    return (
        predictions.orderBy(*order)
        .limit(n)
        .select(
            *order,
            "true_label",
            "true_id",
            "raw_output",
            F.col("predicted_label").alias("matched_label"),
            "predicted_id",
            "status",
        )
    )
