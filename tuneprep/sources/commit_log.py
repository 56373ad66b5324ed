"""The position of a run: a log of what is finished, to which one writer at a time can add.

Each entry is a file of its own number, created only if there is none. Entry n + 1 can be
written only by who has seen entry n, so two runs that work on one log cannot both go
on: the second gets an error, not a mixed log.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.runlog import resume_position
from tuneprep.sources.files import names, publish

ENTRY_SCHEMA = (
    "run_id string, entry bigint, epoch int, chunk int, total_chunks int, validated boolean, n_rows bigint, "
    "n_labels bigint, shards array<string>, written_at timestamp"
)
FIELDS = [field.split()[0] for field in ENTRY_SCHEMA.split(", ")]


class LogConflict(RuntimeError):
    """Another run has written the entry that was to come next."""


class PositionError(RuntimeError):
    """The log was made with another plan."""


def last_entry(spark: SparkSession, path: str) -> int:
    """Number of the last entry, -1 if there is none; a listing only."""
    found = [re.fullmatch(r"entry-(\d+)\.json", name) for name in names(spark, path)]
    return max((int(m.group(1)) for m in found if m), default=-1)


def append(spark: SparkSession, path: str, after: int, entry: Mapping[str, Any]) -> int:
    """Write the entry that follows number ``after`` and return its number.

    ``after`` is the last entry this run has seen; if there is a later one by now, this
    run is not the only one.
    """
    unknown = set(entry) - set(FIELDS)
    if unknown:
        raise KeyError(f"not fields of a log entry: {sorted(unknown)}")
    number = after + 1
    record = {"written_at": datetime.now(UTC).isoformat(), **entry, "entry": number}
    if not publish(spark, f"{path}/entry-{number:012d}.json", json.dumps(record) + "\n"):
        raise LogConflict(f"entry {number} of {path} was written by another run")
    return number


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries; none if the log does not exist."""
    if last_entry(spark, path) < 0:
        return spark.createDataFrame([], ENTRY_SCHEMA)
    return spark.read.schema(ENTRY_SCHEMA).option("pathGlobFilter", "entry-*.json").option("mode", "FAILFAST").json(path)


def position(spark: SparkSession, path: str, total_chunks: int) -> tuple[int, int, bool]:
    """Epoch and chunk a run goes on with, and whether the epoch before still needs its validation.

    An error if the log was made with another number of chunks.
    """
    log = read_log(spark, path)
    found = resume_position(log, total_chunks, order=["entry"]).collect()
    if len(found) > 1:
        raise PositionError(f"{path} holds entries of {len(found)} runs")
    if not found:
        return 1, 1, False
    if found[0]["fault"]:
        raise PositionError(f"{path}: {found[0]['fault']}, the plan has {total_chunks} chunks now")
    return found[0]["start_epoch"], found[0]["start_chunk"], found[0]["needs_validation"]


def history(log: DataFrame) -> DataFrame:
    """The latest entry of each chunk, and whether its epoch was validated."""
    latest = F.max_by(F.struct("total_chunks", "n_rows", "n_labels", "shards", "written_at"), "entry").alias("e")
    return log.groupBy("run_id", "epoch", "chunk").agg(latest, F.bool_or("validated").alias("validated")).select(
        "run_id", "epoch", "chunk", "validated", "e.*"
    )
