"""Parquet shard folders: scan, column mapping, sample index and file audit."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tuneprep.operators.joins import lookup_join
from tuneprep.session import materialise
from tuneprep.sources.files import exists, names

SHARD_PATTERN = r"^train-(\d{5})\.parquet$"
SMALLEST_FILE = 1000


def scan_shards(
    spark: SparkSession, folder: str, schema: StructType | str | None = None
) -> DataFrame:
    """All ``*.parquet`` files of a folder, united by column name.

    Adds ``shard_file``, the file's path below the folder, and ``shard_row``, the
    row's place in its file. A given schema saves the pass over the file footers that
    merging them needs.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    reader = reader.option("mergeSchema", True) if schema is None else reader.schema(schema)
    try:
        df = reader.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"no parquet files in {folder}") from error
        raise
    if schema is not None:
        # The listing alone, one row of it; no file is opened and no list reaches the driver's Python.
        listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        if listing.select("path").isEmpty():
            raise FileNotFoundError(f"no parquet files in {folder}")
    return _located(df, folder)


def _below(path: Column, folder: str) -> Column:
    """The path of a file below the folder; its name if the folder is the file."""
    base = re.escape(folder.rstrip("/").rpartition("/")[2])
    below = F.regexp_extract(path, f"/{base}/(.+)$", 1)
    return F.coalesce(F.nullif(below, F.lit("")), F.element_at(F.split(path, "/"), -1))


def _located(df: DataFrame, folder: str) -> DataFrame:
    return df.select(
        "*",
        _below(F.col("_metadata.file_path"), folder).alias("shard_file"),
        F.col("_metadata.row_index").alias("shard_row"),
    )


def shard_number(file_name: Column, pattern: str = SHARD_PATTERN) -> Column:
    """The shard number in a file name; null if the name does not fit."""
    return F.nullif(F.regexp_extract(file_name, pattern, 1), F.lit("")).cast("int")


def shard_files(spark: SparkSession, folder: str, pattern: str = SHARD_PATTERN) -> DataFrame:
    """The Parquet files below a folder: ``shard_file``, ``path``, ``length``, ``modified``, ``shard_id``.

    A listing: no file is opened. ``pattern`` finds the shard number in the file's path below the folder.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(folder)
    )
    return listing.select(
        _below(F.col("path"), folder).alias("shard_file"),
        "path",
        "length",
        F.col("modificationTime").alias("modified"),
    ).withColumn("shard_id", shard_number(F.col("shard_file"), pattern))


def read_shards(
    spark: SparkSession, folder: str, paths: Sequence[str], schema: StructType | str
) -> DataFrame:
    """The rows of these files of a folder, as ``scan_shards`` gives them; others are neither listed nor opened."""
    if not paths:
        raise FileNotFoundError(f"no files of {folder} are wanted")
    return _located(spark.read.schema(schema).option("basePath", folder).parquet(*paths), folder)


def file_rows(spark: SparkSession, folder: str, paths: Sequence[str] | None = None) -> DataFrame:
    """``shard_file`` and ``n_rows`` of the files of a folder, or of some of them.

    Rows are counted from the files' footers, as no column is asked for.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    files = reader.parquet(folder) if paths is None else spark.read.option("basePath", folder).parquet(*paths)
    # By the path itself: an expression over it would have the other metadata read too.
    counted = files.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(_below(F.col("_path"), folder).alias("shard_file"), "n_rows")


def index_manifest(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """``shard_file``, ``n_rows`` and ``first_index`` of all files, kept as a table at a path.

    Called again, only files that are new, or have another length or time, have their footers
    read. Files in name order give the numbers, so a file that is added in between moves
    those behind it. An empty file has a row too.
    """
    listing = materialise(shard_files(spark, folder).select("shard_file", "path", "length", "modified"), "listing")
    versions = sorted(int(n[8:]) for n in names(spark, path, folders=True) if re.fullmatch(r"version=\d+", n))
    versions = [v for v in versions if exists(spark, f"{path}/version={v}/_SUCCESS")]
    known = None
    if versions:
        known = spark.read.parquet(f"{path}/version={versions[-1]}")
        same = known.join(listing, ["shard_file", "length", "modified"], "left_semi")
        fresh = listing.join(known, ["shard_file", "length", "modified"], "left_anti")
    else:
        fresh = listing
    # As many paths as files were added since the last call; Spark lists them on the driver too.
    paths = [r["path"] for r in fresh.select("path").collect()]
    if versions and not paths and same.count() == known.count():
        return _offsets(known)
    counted = fresh.select("shard_file", "length", "modified")
    if paths:
        counted = counted.join(file_rows(spark, folder, paths), "shard_file", "left")
    # Files without rows are not among those counted.
    counted = counted.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)) if paths else F.lit(0).cast("bigint"))
    table = counted if known is None else same.unionByName(counted)
    target = f"{path}/version={versions[-1] + 1 if versions else 0}"
    table.select("shard_file", "length", "modified", "n_rows").write.mode("overwrite").parquet(target)
    return _offsets(spark.read.parquet(target))


def _offsets(files: DataFrame) -> DataFrame:
    """One task, over one row for each file."""
    earlier = W.orderBy("shard_file").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("first_index")
    return files.select("shard_file", "n_rows", first)


def with_index(rows: DataFrame, files: DataFrame, index: str = "index") -> DataFrame:
    """Number rows from 0 through all files in name order, as they are stored.

    ``files`` (``shard_file``, ``n_rows``, from ``file_rows`` or ``index_manifest``) is counted from
    the folder, so a filter on the rows changes no number. The place of a row is the
    number of rows in earlier files plus its place in its own: no row is moved. A row of a file
    that was not counted, or that has become longer, is an error.
    """
    offsets = _offsets(files).withColumnsRenamed({"n_rows": "_rows", "first_index": "_before"})
    stale = F.raise_error(F.lit("the files have changed since their rows were counted")).cast("bigint")
    joined = lookup_join(rows, offsets, "shard_file", "left", ["shard_file", "shard_row"])
    known = F.col("_rows").isNotNull() & (F.col("shard_row") < F.col("_rows"))
    return joined.withColumn(index, F.when(known, F.col("_before") + F.col("shard_row")).otherwise(stale)).drop("_before", "_rows")


def check_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    return df


def map_columns(
    df: DataFrame,
    image: str = "image",
    disease: str = "disease",
    crop: str = "crop",
    label_id: str = "",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rename configured columns to the names used here.

    ``""`` means that there is no such column; so does a crop or label id column
    that the files lack. Image and disease must exist.
    """
    check_columns(df, [image, disease])
    optional = {"crop": crop, "label_id": label_id}
    return df.select(
        *keep,
        F.col(image).alias("image"),
        F.col(disease).cast("string").alias("disease"),
        *[
            (F.col(name) if name and name in df.columns else F.lit(None)).cast("string").alias(target)
            for target, name in optional.items()
        ],
    )


def shard_audit(
    spark: SparkSession,
    folder: str,
    total: int,
    wanted: Sequence[int] | None = None,
    smallest: int = SMALLEST_FILE,
    pattern: str = SHARD_PATTERN,
) -> DataFrame:
    """State of the shard files of a folder; nothing is read or deleted."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    )
    return audit_listing(listing, total, wanted, smallest, pattern)


def audit_listing(
    listing: DataFrame,
    total: int,
    wanted: Sequence[int] | None = None,
    smallest: int = SMALLEST_FILE,
    pattern: str = SHARD_PATTERN,
) -> DataFrame:
    """State of the shards in a list of files (``file``, ``length``), however it was made.

    Every wanted shard is ``ok``, ``too_small``, ``unfinished`` (only a ``.tmp``
    file) or ``missing``; files of other shards are ``stale``.
    """
    finished = F.regexp_replace("file", r"\.tmp$", "")
    files = listing.select(
        shard_number(finished, pattern).alias("shard_id"),
        F.when(~F.endswith("file", F.lit(".tmp")), F.col("length")).alias("length"),
        F.endswith("file", F.lit(".tmp")).alias("tmp"),
    ).where(F.col("shard_id").isNotNull())
    present = files.groupBy("shard_id").agg(
        F.max("length").alias("length"), F.bool_or("tmp").alias("tmp")
    )
    plan = listing.sparkSession.range(total).select(F.col("id").cast("int").alias("shard_id"))
    if wanted is not None:
        plan = plan.where(F.col("shard_id").isin(list(wanted)))
    plan = plan.withColumn("_wanted", F.lit(True))
    state = (
        F.when(F.col("_wanted").isNull(), F.lit("stale"))
        .when(F.col("length") > smallest, F.lit("ok"))
        .when(F.col("length").isNotNull(), F.lit("too_small"))
        .when(F.col("tmp"), F.lit("unfinished"))
        .otherwise(F.lit("missing"))
    )
    return plan.join(present, "shard_id", "full").select(
        "shard_id", "length", state.alias("state")
    )
