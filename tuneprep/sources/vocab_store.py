"""The vocabulary on disk: one folder per version, and JSON for exchange."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.operators.vocab import VocabularyError, build_vocab, require_valid
from tuneprep.session import materialise
from tuneprep.sources.files import rename_new

_SCHEMA = "label string, label_id int"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of a path on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _started(spark: SparkSession, path: str) -> list[int]:
    """Versions that have a folder, the newest first; one listing."""
    found = [re.fullmatch(r"version=(\d+)", name) for name in _folders(spark, path)]
    return sorted((int(m.group(1)) for m in found if m), reverse=True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written to the end, in order."""
    started = _started(spark, path)
    return sorted(v for v in started if _complete(spark, f"{path}/version={v}"))


def save_vocab(vocab: DataFrame, path: str, version: int) -> DataFrame:
    """Check and write a version; writing it again replaces it."""
    target = f"{path}/version={version}"
    table = vocab.select("label", F.col("label_id").cast("int").alias("label_id"))
    # Made once, checked, then published.
    made = require_valid(materialise(table, "vocab"))
    made.write.mode("overwrite").parquet(target)
    return vocab.sparkSession.read.schema(_SCHEMA).parquet(target)


def load_vocab(
    spark: SparkSession, path: str, version: int | None = None, before: int | None = None
) -> DataFrame | None:
    """A version (the last one by default, or the last before a number); None if absent.

    Folders are looked at from the newest down until one is complete, so the number of
    calls does not grow with the versions.
    """
    for found in _started(spark, path) if version is None else [version]:
        if (before is None or found < before) and _complete(spark, f"{path}/version={found}"):
            version = found
            break
    else:
        return None
    return require_valid(spark.read.schema(_SCHEMA).parquet(f"{path}/version={version}"))


def create_vocab(vocab: DataFrame, path: str, version: int = 0) -> bool:
    """Check and write a version that must not exist yet; False if another writer was first.

    The version is written under a name of its own and then renamed, so of several writers
    of one version one succeeds, and no reader sees a part of it. A vocabulary that was read
    as version n and extended is published as n + 1: False says that someone else
    has extended it, and that the extension must be made again from what is there.
    """
    spark, draft = vocab.sparkSession, f"{path}/.draft-{uuid.uuid4().hex}"
    table = vocab.select("label", F.col("label_id").cast("int").alias("label_id"))
    require_valid(materialise(table, "vocab")).write.parquet(draft)
    return rename_new(spark, draft, f"{path}/version={version}")


def load_or_create_vocab(df: DataFrame, path: str, label_col: str = "disease") -> DataFrame:
    """The stored vocabulary if there is one, else that of the rows, stored as version 0.

    If several jobs create it at once, all get the one that was stored first.
    """
    stored = load_vocab(df.sparkSession, path)
    if stored is None:
        create_vocab(build_vocab(df, label_col), path)
        stored = load_vocab(df.sparkSession, path)
    return stored


def vocab_to_json(vocab: DataFrame) -> DataFrame:
    """One row, one column ``value``: ``{"label2id": {..}, "id2label": {..}}``.

    The document is one object and so one row, made in one task, whatever the size: an
    exchange format for the classes of a classifier. The table itself is the Parquet version.
    """
    ordered = F.array_sort(F.collect_list(F.struct("label_id", "label")))
    return (
        require_valid(vocab)
        .agg(ordered.alias("e"))
        .select(
            F.to_json(
                F.struct(
                    F.map_from_entries(
                        F.transform("e", lambda x: F.struct(x["label"], x["label_id"]))
                    ).alias("label2id"),
                    F.map_from_entries(
                        F.transform(
                            "e", lambda x: F.struct(x["label_id"].cast("string"), x["label"])
                        )
                    ).alias("id2label"),
                )
            ).alias("value")
        )
    )


def write_vocab_json(vocab: DataFrame, path: str) -> None:
    vocab_to_json(vocab).write.mode("overwrite").text(path)


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary of a JSON document, checked."""
    read = spark.read.text(path, wholetext=True)
    parsed = read.select(
        F.from_json("value", "label2id map<string,int>, id2label map<string,string>").alias("j")
    )
    if parsed.where(F.col("j.label2id").isNull()).take(1):
        raise VocabularyError(f"no label2id in {path}")
    return require_valid(parsed.select(F.explode("j.label2id").alias("label", "label_id")))
