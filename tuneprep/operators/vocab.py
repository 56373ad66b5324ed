"""The label vocabulary: a table ``(label, label_id)`` whose ids never change.

It holds one row per class of the classifier. The only window without a partition
in this module runs over the ranges that new labels are numbered in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tuneprep.functions.text import clean_label, normalise_label
from tuneprep.operators.ordering import hash_cut, seeded_hash
from tuneprep.session import materialise

PREVIEW = 50
# So many labels, once counted, are numbered in one task.
ONE_TASK_LABELS = 10_000


class VocabularyError(ValueError):
    """The vocabulary, or the labels checked against it, break a rule."""


def label_column(df: DataFrame, label_col: str) -> DataFrame:
    """Only the label column, stripped, without null and blank labels."""
    return (
        df.select(F.col(label_col).cast("string").alias("label"))
        .where(F.col("label").isNotNull())
        .select(clean_label(F.col("label")).alias("label"))
        .where(F.col("label").isNotNull())
    )


def distinct_labels(df: DataFrame, label_col: str) -> DataFrame:
    return label_column(df, label_col).distinct()


def _numbered(labels: DataFrame, order: Sequence[str], first: Column | int = 0) -> DataFrame:
    """``label`` and ``label_id``: numbers from ``first`` on in the given order.

    The labels are written once and counted. Few are ordered in one task. Otherwise they are
    written down in ranges of the order, and a number is the count of the labels in
    earlier ranges plus the place in its own, so no task sees all labels; only one row per
    range is ordered in one place. Both ways give the same numbers.
    """
    labels = materialise(labels, "labels")
    start = first if isinstance(first, Column) else F.lit(first)
    if labels.count() <= ONE_TASK_LABELS:
        place = F.row_number().over(W.orderBy(*order)) - 1
        return labels.select("label", (start + place).cast("int").alias("label_id"))
    ranged = labels.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "label-ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(before, "_range").select(
        "label", (start + F.col("_before") + place).cast("int").alias("label_id")
    )


def build_vocab(df: DataFrame, label_col: str = "disease") -> DataFrame:
    """Distinct labels in code-point order, numbered from 0."""
    return _numbered(distinct_labels(df, label_col), ["label"])


def build_vocab_from_sample(
    df: DataFrame, key: str, label_col: str = "disease", n: int | None = None, seed: int = 42
) -> DataFrame:
    """The vocabulary of all rows, or of ``n`` rows taken in seeded order.

    A bound leaves out labels, whose rows are later unknown; give one only where the
    source has no end.
    """
    if n is None:
        return build_vocab(df, label_col)
    hashed = df.select(seeded_hash(seed, key).alias("_h"), label_col)
    return build_vocab(hashed.where(F.col("_h") <= hash_cut(hashed, "_h", n=n)), label_col)


def added_labels(
    vocab: DataFrame, df: DataFrame, label_col: str = "disease", order_by: str = "label"
) -> DataFrame:
    """The labels not seen before, with the ids that follow the last one.

    They are numbered in code-point order of the stripped label, or with
    ``order_by="raw"`` of the first raw spelling.
    """
    if order_by not in ("label", "raw"):
        raise ValueError(f"order_by is 'label' or 'raw', not {order_by!r}")
    spelled = (
        df.select(F.col(label_col).cast("string").alias("raw"))
        .where(F.col("raw").isNotNull())
        .select(clean_label(F.col("raw")).alias("label"), "raw")
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.min("raw").alias("raw"))
    )
    fresh = spelled.join(vocab.select("label"), "label", "left_anti")
    last = vocab.agg(F.coalesce(F.max("label_id"), F.lit(-1))).scalar()
    return _numbered(fresh, [order_by], last + 1)


def extend_vocab(
    vocab: DataFrame, df: DataFrame, label_col: str = "disease", order_by: str = "label"
) -> DataFrame:
    """Append the labels not seen before (``added_labels``); every existing id stays."""
    return vocab.select("label", "label_id").unionByName(added_labels(vocab, df, label_col, order_by))


def vocab_over_chunks(
    df: DataFrame, chunk_col: str, label_col: str = "disease", vocab: DataFrame | None = None
) -> DataFrame:
    """The vocabulary after all chunks in order, in one aggregation.

    Extending chunk by chunk numbers a label by the first chunk that holds it and,
    within that chunk, by the label; so the loop is not needed.
    """
    first = (
        df.select(clean_label(F.col(label_col)).alias("label"), F.col(chunk_col).alias("chunk"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.min("chunk").alias("chunk"))
    )
    if vocab is None:
        return _numbered(first, ["chunk", "label"])
    fresh = first.join(vocab.select("label"), "label", "left_anti")
    last = vocab.agg(F.coalesce(F.max("label_id"), F.lit(-1))).scalar()
    added = _numbered(fresh, ["chunk", "label"], last + 1)
    return vocab.select("label", "label_id").unionByName(added)


def missing_labels(vocab: DataFrame, df: DataFrame, label_col: str = "disease") -> DataFrame:
    """Labels of the rows that the vocabulary lacks."""
    return distinct_labels(df, label_col).join(vocab.select("label"), "label", "left_anti")


def _label_counts(vocab: DataFrame, df: DataFrame, label_col: str) -> DataFrame:
    known = vocab.select("label", F.lit(True).alias("_known"))
    return distinct_labels(df, label_col).join(known, "label", "left").agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.count_if(F.col("_known").isNull()).alias("n_missing"),
    )


def preflight(vocab: DataFrame, df: DataFrame, label_col: str = "disease") -> DataFrame:
    """One row: labels found, labels missing, and the first 50 missing ones."""
    first = missing_labels(vocab, df, label_col).orderBy("label").limit(PREVIEW)
    preview = first.agg(F.array_sort(F.collect_list("label"))).scalar()
    return _label_counts(vocab, df, label_col).withColumn("preview", preview)


def require_labels(vocab: DataFrame, df: DataFrame, label_col: str = "disease") -> int:
    """Raise if a label is missing from the vocabulary, else return the label count."""
    found = _label_counts(vocab, df, label_col).first()
    if found["n_missing"]:
        first = preflight(vocab, df, label_col).first()["preview"]
        raise VocabularyError(
            f"{found['n_missing']} of {found['n_labels']} labels are not in the vocabulary, "
            f"first: {first}"
        )
    return found["n_labels"]


def violations(vocab: DataFrame) -> DataFrame:
    """Broken rules as rows ``(rule, detail)``; an intact vocabulary gives none."""
    entries = vocab.select(
        F.coalesce(clean_label(F.col("label")), F.lit("")).alias("label"),
        F.col("label_id").cast("bigint").alias("label_id"),
    )

    def found(frame: DataFrame, rule: str, detail: Column) -> DataFrame:
        return frame.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))

    by_label = entries.groupBy("label").agg(
        F.min("label_id").alias("low"), F.max("label_id").alias("high")
    )
    by_id = entries.groupBy("label_id").agg(
        F.min("label").alias("low"), F.max("label").alias("high")
    )
    summary = entries.agg(
        F.count_distinct("label").alias("n"),
        F.count_distinct("label_id").alias("n_ids"),
        F.min("label_id").alias("low"),
        F.max("label_id").alias("high"),
    )
    not_contiguous = (F.col("n") > 0) & (
        (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("n_ids") != F.col("n"))
    )
    return (
        found(summary.where(F.col("n") == 0), "empty_vocabulary", F.lit(""))
        .unionByName(found(entries.where(F.col("label") == ""), "empty_label", F.col("label_id")))
        .unionByName(found(entries.where(F.col("label_id") < 0), "negative_id", F.col("label")))
        .unionByName(
            found(by_label.where(F.col("low") != F.col("high")), "two_ids", F.col("label"))
        )
        .unionByName(
            found(by_id.where(F.col("low") != F.col("high")), "shared_id", F.col("label_id"))
        )
        .unionByName(
            found(
                summary.where(not_contiguous),
                "not_contiguous",
                F.concat_ws("/", "n", "n_ids", "low", "high"),
            )
        )
    )


def require_valid(vocab: DataFrame) -> DataFrame:
    """The vocabulary itself, or an error that shows the first violations.

    One aggregate settles the normal case; the rules are looked at one by one only
    if it does not.
    """
    label, number = clean_label(F.col("label")), F.col("label_id").cast("bigint")
    seen = vocab.agg(
        F.count(label).alias("n"),
        F.count_distinct(label).alias("n_labels"),
        F.count_distinct(number).alias("n_ids"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
    ).first()
    if seen["n"] and len({seen[c] for c in ("n", "n_labels", "n_ids", "n_rows")}) == 1:
        if (seen["low"], seen["high"]) == (0, seen["n"] - 1):
            return vocab
    broken = violations(vocab).take(5)
    if broken:
        raise VocabularyError("; ".join(f"{r['rule']}: {r['detail']}" for r in broken))
    return vocab


def inverse_vocab(vocab: DataFrame) -> DataFrame:
    """The table keyed by id."""
    return vocab.select(F.col("label_id").cast("int").alias("label_id"), "label")


def normalised_vocab(vocab: DataFrame) -> DataFrame:
    """Vocabulary with the normalised form of each label.

    ``fault`` is null, ``empty_after_normalise``, or ``collision`` where two entries
    share a form, be they two labels or one label with two ids.
    """
    forms = vocab.select("label", "label_id", normalise_label(F.col("label")).alias("norm"))
    shared = W.partitionBy("norm")
    two = F.count(F.lit(1)).over(shared) > 1
    fault = F.when(F.col("norm") == "", F.lit("empty_after_normalise")).when(
        two, F.lit("collision")
    )
    return forms.select("norm", "label", "label_id", fault.alias("fault"))
