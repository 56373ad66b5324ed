"""The shared folder in which intermediate tables are kept."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a master of one machine may run without the setting; tables are then
    kept below its warehouse.
    """
    folder = spark.conf.get(_CHECKPOINT_SETTING, None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_CHECKPOINT_SETTING} must name a folder shared by all executors")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/tuneprep-intermediate"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def held(spark: SparkSession, setting: str, value: int | str) -> Iterator[None]:
    """Hold a setting of the session while the block runs."""
    before = spark.conf.get(setting)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    It cuts the lineage, survives lost executors and gives Catalyst a measured
    size. Meant for tables that several jobs use: vocabularies, bucket counts.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
