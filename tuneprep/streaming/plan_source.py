"""A stream of positions in a chunk plan.

A position is the number of a chunk in the order of the plan, epoch after epoch. The
stream carries positions only; the rows of a chunk are read by Spark's own reader, for
each position from the files that the plan names. So the order of a run is that of the plan,
whatever the times of the files, and files of other chunks are neither listed nor opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Position(InputPartition):
    def __init__(self, position: int):
        self.position = position


class PlanReader(DataSourceStreamReader):
    """One position for each micro-batch, from ``first`` to the last of ``positions``."""

    def __init__(self, first: int, positions: int):
        self.first, self.positions = first, positions
        self.at = first

    def initialOffset(self) -> dict:
        return {"position": self.first}

    def latestOffset(self) -> dict:
        # Asked once for each micro-batch; at the end it stands still, and no more batches are made.
        self.at = min(self.at + 1, self.positions)
        return {"position": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Position(p) for p in range(start["position"], end["position"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.position,)

    def commit(self, end: dict) -> None:
        """Positions are kept by the commit log."""


class PlanSource(DataSource):
    """Options: ``positions``, how many there are, and ``first``, the one to begin with."""

    @classmethod
    def name(cls) -> str:
        return "chunk_plan"

    def schema(self) -> str:
        return "position bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PlanReader(int(self.options["first"]), int(self.options["positions"]))


def position_stream(spark: SparkSession, positions: int, first: int = 0) -> DataFrame:
    """The positions from ``first`` on as a stream, one for each micro-batch."""
    spark.dataSource.register(PlanSource)
    return spark.readStream.format("chunk_plan").option("positions", positions).option("first", first).load()
