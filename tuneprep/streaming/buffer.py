"""A seeded shuffle buffer over a stream of chunks, and the first n rows that leave it.

The buffer is a table of at most ``size`` rows that lasts from chunk to chunk. A step puts the rows of
a chunk into it; what is then beyond its size leaves it, the rows that come first in a seeded
order of the step. So rows move by more than a chunk only with luck, as with any bounded
buffer, and memory does not follow the stream. Ranks and cuts come from counts of hashes, so no
task orders a whole chunk. The same seed gives the same order whatever the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.ordering import hash_rank, seeded_hash
from tuneprep.session import materialise
from tuneprep.sources.files import delete, exists, names, publish


@dataclass(frozen=True)
class ShuffleBuffer:
    """Buffer of a run at a path. ``key`` must tell rows apart; ``limit`` is the number of rows wanted, None for all."""

    spark: SparkSession
    path: str
    key: Sequence[str]
    size: int = 1000
    seed: int = 42
    limit: int | None = None

    def _state(self, step: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/state/step-{step:09d}.json").first()[0])

    def _steps(self) -> list[int]:
        return [int(n[5:14]) for n in names(self.spark, f"{self.path}/state") if n.startswith("step-")]

    def full(self) -> bool:
        """Whether as many rows as are wanted have left the buffer, so that no more need be read."""
        steps = self._steps()
        return self.limit is not None and bool(steps) and self._state(max(steps))["left"] >= self.limit

    def push(self, rows: DataFrame, step: int) -> None:
        """Put the rows of a step in, and write those that leave with their ``position``.

        A step that is done again replaces itself, and what was done after it is dropped.
        """
        self._step(rows, step, self.size)

    def flush(self) -> None:
        """Let the rest leave; for the end of the stream."""
        steps = self._steps()
        if steps and not self._state(max(steps))["flushed"]:
            self._step(None, max(steps) + 1, 0)

    def _step(self, rows: DataFrame | None, step: int, size: int) -> None:
        for later in (s for s in self._steps() if s >= step):
            delete(self.spark, f"{self.path}/state/step-{later:09d}.json")
        earlier = [s for s in self._steps() if s < step]
        state = self._state(max(earlier)) if earlier else {"left": 0}
        held = self.spark.read.parquet(f"{self.path}/held/step={max(earlier)}") if earlier else None
        pool = held if rows is None else rows if held is None else rows.unionByName(held.select(*rows.columns))
        hashed = materialise(pool.withColumn("_h", seeded_hash(self.seed, *self.key, epoch=step)), "pool")
        leaving = max(0, hashed.count() - size)
        ranked = materialise(hash_rank(hashed, "_h", "_rank").drop("_h"), "ranked")
        out = ranked.where(F.col("_rank") <= leaving)
        out = out.withColumn("position", F.col("_rank") - 1 + state["left"]).drop("_rank")
        if self.limit is not None:
            out = out.where(F.col("position") < self.limit)
        out.write.mode("overwrite").parquet(f"{self.path}/left/step={step}")
        ranked.where(F.col("_rank") > leaving).drop("_rank").write.mode("overwrite").parquet(f"{self.path}/held/step={step}")
        # The step counts from here on.
        publish(
            self.spark,
            f"{self.path}/state/step-{step:09d}.json",
            json.dumps({"left": state["left"] + leaving, "flushed": rows is None}),
        )

    def left(self) -> DataFrame | None:
        """All rows that have left the buffer, with their positions; None before the first step."""
        paths = [f"{self.path}/left/step={s}" for s in self._steps() if exists(self.spark, f"{self.path}/left/step={s}/_SUCCESS")]
        return self.spark.read.parquet(*paths) if paths else None
