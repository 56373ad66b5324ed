"""A vocabulary that grows: each version adds its new labels to a list of segments.

A segment is a folder that holds the labels added by the versions ``first`` to ``last``; its
name also says how many. The vocabulary of a version is the union of the segments up to
it. Segments are merged while the one before is less than twice as large, so there are
few, at most the binary logarithm of the labels, and a label is rewritten as often at
most: what a chunk writes follows its new labels and not the vocabulary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tuneprep.operators.vocab import VocabularyError, require_valid
from tuneprep.session import materialise
from tuneprep.sources.files import delete, exists, names

_SCHEMA = "label string, label_id int"


@dataclass(frozen=True)
class Segment:
    first: int
    last: int
    rows: int

    @property
    def name(self) -> str:
        return f"segment={self.first}-{self.last}-{self.rows}"


def _listed(spark: SparkSession, path: str) -> list[Segment]:
    found = [re.fullmatch(r"segment=(\d+)-(\d+)-(\d+)", name) for name in names(spark, path, folders=True)]
    return [Segment(*map(int, m.groups())) for m in found if m]


def segments(spark: SparkSession, path: str, before: int | None = None) -> list[Segment]:
    """The segments that make up the vocabulary, in order; merged ones instead of their parts."""
    rest = [s for s in _listed(spark, path) if before is None or s.last < before]
    chosen: list[Segment] = []
    end = -1
    # At each place the widest complete segment.
    for s in sorted(rest, key=lambda s: (s.first, -s.last)):
        if s.first > end and exists(spark, f"{path}/{s.name}/_SUCCESS"):
            chosen.append(s)
            end = s.last
    return chosen


def _read(spark: SparkSession, path: str, parts: list[Segment]) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(*[f"{path}/{s.name}" for s in parts])


def load(
    spark: SparkSession, path: str, before: int | None = None, check: bool = True
) -> DataFrame | None:
    """The vocabulary of all versions, or of those before a number; None if there are none."""
    parts = segments(spark, path, before)
    if not parts:
        return None
    vocab = _read(spark, path, parts)
    if not check:
        return vocab
    if sum(s.rows for s in parts) != vocab.count():
        raise VocabularyError(f"{path} does not hold the labels that its segments name")
    return require_valid(vocab)


def append(added: DataFrame, path: str, version: int) -> list[Segment]:
    """Write the labels that a version adds (numbered from the count of those before) and merge small segments.

    A version that is written again replaces itself, and whatever was written after it.
    """
    spark = added.sparkSession
    for s in _listed(spark, path):
        if s.last >= version:
            delete(spark, f"{path}/{s.name}")
    parts = segments(spark, path)
    new = materialise(added.select("label", added["label_id"].cast("int").alias("label_id")), "added")
    extent = new.selectExpr("count(*) as n", "min(label_id) as low", "max(label_id) as high").first()
    rows, low, high = extent
    known = sum(s.rows for s in parts)
    if not rows:
        return parts
    if (low, high) != (known, known + rows - 1):
        raise VocabularyError(f"new labels must have the ids {known} to {known + rows - 1}, not {low} to {high}")
    own = Segment(version, version, rows)
    new.write.mode("overwrite").parquet(f"{path}/{own.name}")
    parts.append(own)
    return _merged(spark, path, parts)


def _merged(spark: SparkSession, path: str, parts: list[Segment]) -> list[Segment]:
    """One merge of the last segments, as many as are needed for each to be half of the one before at most.

    The parts stay where they are, for readers that have them open.
    """
    start, rows = len(parts) - 1, parts[-1].rows
    while start and parts[start - 1].rows < 2 * rows:
        start -= 1
        rows += parts[start].rows
    if start == len(parts) - 1:
        return parts
    whole = Segment(parts[start].first, parts[-1].last, rows)
    _read(spark, path, parts[start:]).write.mode("overwrite").parquet(f"{path}/{whole.name}")
    return [*parts[:start], whole]
