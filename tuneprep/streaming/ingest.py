"""Rolling ingest: chunk after chunk of a plan, a vocabulary that grows, a position that lasts.

One log (``sources.commit_log``) holds the position. A run that was killed is started again
with the same call: it goes on behind the last entry, does the chunk that was cut short once
more under its own number, and first makes up for a validation that was not done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tuneprep.operators.splits import chunk_plan
from tuneprep.operators.vocab import added_labels, build_vocab, distinct_labels, require_labels
from tuneprep.session import materialise
from tuneprep.sources import commit_log, vocab_increments
from tuneprep.sources.files import exists
from tuneprep.sources.shards import SHARD_PATTERN, file_rows, read_shards, shard_files
from tuneprep.streaming.plan_source import position_stream

Work = Callable[[DataFrame, DataFrame, int], None]
Validation = Callable[[int, DataFrame], None]


def shard_plan(
    spark: SparkSession,
    folder: str,
    chunk_size: int = 2,
    max_chunks: int | None = None,
    shards: tuple[int, int] | None = None,
    pattern: str = SHARD_PATTERN,
) -> DataFrame:
    """The chunk plan of the shard files of a folder: ``chunk``, ``shard_id``, ``shard_file``, ``path``.

    Files are ordered by shard number, then name. ``shards`` are the first and the last number wanted.
    """
    files = shard_files(spark, folder, pattern).where(F.col("shard_id").isNotNull())
    if shards is not None:
        files = files.where(F.col("shard_id").between(*shards))
    order = F.format_string("%012d %s", "shard_id", "shard_file")
    plan = chunk_plan(files.withColumn("_order", order), "_order", chunk_size, max_chunks)
    return plan.select("chunk", "shard_id", "shard_file", "path")


def grow_vocab(labels: DataFrame, path: str, version: int) -> DataFrame:
    """The vocabulary before a version, extended by the labels (column ``label``); only the new ones are written."""
    spark = labels.sparkSession
    known = vocab_increments.load(spark, path, before=version)
    added = build_vocab(labels, "label") if known is None else added_labels(known, labels, "label")
    # Checked when it was read, and what is added is checked against it.
    vocab_increments.append(added, path, version)
    return vocab_increments.load(spark, path, before=version + 1, check=False)


@dataclass
class Run:
    """One run over a plan. ``folder`` holds its plan, log, vocabulary and the stream's own bookkeeping."""

    spark: SparkSession
    plan: DataFrame
    source: str
    schema: StructType | str
    folder: str
    run_id: str = "run"
    label_col: str = "disease"
    epochs: int = 1
    work: Work | None = None
    validate: Validation | None = None

    @property
    def log_path(self) -> str:
        return f"{self.folder}/log"

    @property
    def vocab_path(self) -> str:
        return f"{self.folder}/vocab"

    def fixed_plan(self) -> DataFrame:
        """The plan as the run began with it: files that come later do not move its chunks."""
        path = f"{self.folder}/plan"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            self.plan.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def vocab(self) -> DataFrame | None:
        return vocab_increments.load(self.spark, self.vocab_path)

    def log(self) -> DataFrame:
        return commit_log.read_log(self.spark, self.log_path)

    def start(self):
        """Start, or go on; returns the streaming query, or None if nothing is left to do."""
        plan = self.fixed_plan()
        self._chunks = plan
        self._total = plan.agg(F.coalesce(F.max("chunk"), F.lit(0))).first()[0]
        if not self._total:
            return None
        epoch, chunk, unvalidated = commit_log.position(self.spark, self.log_path, self._total)
        self._entry = commit_log.last_entry(self.spark, self.log_path)
        if unvalidated:
            self._finish_epoch(epoch - 1)
        self._next = (epoch - 1) * self._total + chunk - 1
        if self._next >= self.epochs * self._total:
            return None
        stream = position_stream(self.spark, self.epochs * self._total, self._next)
        return (
            stream.writeStream.foreachBatch(lambda batch, _: self._positions(batch))
            .option("checkpointLocation", f"{self.folder}/stream")
            .start()
        )

    def finish(self) -> None:
        """Start, or go on, and wait until the last chunk is done."""
        query = self.start()
        if query is not None:
            try:
                # After a batch that is done again, the stream has nothing new for a moment.
                while self._next < self.epochs * self._total:
                    query.processAllAvailable()
            finally:
                query.stop()

    def _positions(self, batch: DataFrame) -> None:
        # One row for each micro-batch; one that was done before the stream noted it is not done again.
        for position in sorted(r["position"] for r in batch.collect()):
            if position >= self._next:
                self._chunk(position)
                self._next = position + 1

    def _chunk(self, position: int) -> None:
        epoch, chunk = position // self._total + 1, position % self._total + 1
        files = self._chunks.where(F.col("chunk") == chunk).orderBy("shard_file").select("shard_file", "path").collect()
        paths = [r["path"] for r in files]
        rows = read_shards(self.spark, self.source, paths, self.schema)
        # The chunk is read once for its labels; the rest works on the distinct ones.
        labels = materialise(distinct_labels(rows, self.label_col), "chunk-labels")
        vocab = grow_vocab(labels, self.vocab_path, position)
        n_labels = 0 if vocab is None else require_labels(vocab, labels, "label")
        if self.work is not None:
            self.work(rows, vocab, position)
        n_rows = file_rows(self.spark, self.source, paths).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        self._append(epoch, chunk, False, n_rows, n_labels, [r["shard_file"] for r in files])
        if chunk == self._total:
            self._finish_epoch(epoch)

    def _finish_epoch(self, epoch: int) -> None:
        if self.validate is not None:
            self.validate(epoch, self.vocab())
        self._append(epoch, self._total, True, None, None, None)

    def _append(self, epoch, chunk, validated, n_rows, n_labels, shards) -> None:
        entry = {
            "run_id": self.run_id,
            "epoch": epoch,
            "chunk": chunk,
            "total_chunks": self._total,
            "validated": validated,
            "n_rows": n_rows,
            "n_labels": n_labels,
            "shards": shards,
        }
        self._entry = commit_log.append(self.spark, self.log_path, self._entry, entry)
