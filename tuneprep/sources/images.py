"""Images that rows name by path, looked up in the folder that holds their files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.functions.pixels import image_format, payload_fault, payload_kind
from tuneprep.operators.joins import lookup_join, salted_join
from tuneprep.session import held, materialise

# Format and size stand in the first bytes of a file.
HEADER = 32
# Larger files are listed and not opened.
LARGEST_FILE = 256 * 1024 * 1024
# Tasks that list a tree of folders.
LISTING, LISTING_TASKS_PER_CORE = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4
# So many bytes a file counts for besides its own when files are dealt to the tasks that read headers. With Spark's
# 4 MB a task gets a few files, however small, and starting it takes longer than reading them.
OPEN_COST, IMAGE_OPEN_COST = "spark.sql.files.openCostInBytes", "32k"

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)"


def _folder_path(folder: str) -> str:
    path = re.sub("/+", "/", re.sub(SCHEME, "", folder)).rstrip("/")
    if not folder.strip("/") or not re.match("/|" + SCHEME, folder):
        raise ValueError(f"the folder of images must be an absolute path or URI: {folder!r}")
    return path


def path_below(path: Column, folder: str) -> Column:
    """A path as it stands below the folder, however it is written: relative, absolute, or with a scheme.

    An absolute path outside the folder stays as it is, and names no file there.
    """
    base = _folder_path(folder) + "/"
    plain = F.regexp_replace(F.regexp_replace(path, SCHEME, ""), "/(\\./|/)*", "/")
    plain = F.regexp_replace(plain, r"^\./", "")
    return F.when(F.startswith(plain, F.lit(base)), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)


def image_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path``, ``length`` and ``content`` of the files below a folder.

    Spark lists a tree of many folders in a job of one task for each folder, up to 10,000, and
    starting them takes longer than listing; here it has a few for each core. The setting holds while listing.
    """
    _folder_path(folder)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    tasks = min(int(spark.conf.get(LISTING)), LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    with held(spark, LISTING, tasks):
        return listed.load(folder)


def image_headers(
    spark: SparkSession, folder: str, pattern: str = "*", header: int = HEADER, largest: int = LARGEST_FILE
) -> DataFrame:
    """``image_path`` below the folder, ``length`` and the first bytes, ``header``, of its files.

    Only the header leaves the task that reads a file. A file of more than ``largest`` bytes
    is not opened, and its header is null. The table is written, so files are read once.
    Files are told apart by the size that was listed, so Spark starts no tasks for the others if there are none.
    """
    files = image_files(spark, folder, pattern)
    name = path_below(F.col("path"), folder).alias("image_path")
    listed = F.col("_metadata.file_size")
    opened = files.where(listed <= largest).select(name, "length", F.substring("content", 1, header).alias("header"))
    others = files.where(listed > largest).select(name, "length", F.lit(None).cast("binary").alias("header"))
    with held(spark, OPEN_COST, IMAGE_OPEN_COST):
        return materialise(opened.unionByName(others), "image-headers")


def _keyed(rows: DataFrame, image: Column, folder: str) -> DataFrame:
    wanted = F.when(payload_kind(image) == "path", path_below(image["path"], folder))
    return rows.withColumn("image_path", wanted)


def with_headers(
    rows: DataFrame, image: Column, headers: DataFrame, folder: str, row_key: Sequence[str]
) -> DataFrame:
    """Add ``header`` and ``length``: of the image's bytes, or of the file that its path names.

    ``image`` is what ``payload`` gives. Both are null for an array, for no image and for a
    path without a file; ``header`` alone is for a file that was too large to open. A path
    that many rows name is spread by ``row_key`` if the headers are too many to broadcast.
    """
    table = headers.select("image_path", F.struct("length", "header").alias("_file"))
    found = lookup_join(_keyed(rows, image, folder), table, "image_path", "left", row_key)
    inline = payload_kind(image) == "bytes"
    return found.select(
        *rows.columns,
        F.when(inline, F.substring(image["bytes"], 1, HEADER)).otherwise(F.col("_file.header")).alias("header"),
        F.when(inline, F.octet_length(image["bytes"]).cast("bigint")).otherwise(F.col("_file.length")).alias("length"),
    )


def file_fault(image: Column, header: Column, length: Column) -> Column:
    """``payload_fault``, and what the file of a path is found to be; null if nothing speaks against it."""
    by_path = payload_kind(image) == "path"
    return (
        F.when(by_path & length.isNull(), F.lit("missing_file"))
        .when(by_path & header.isNull(), F.lit("too_large"))
        .when(by_path & image_format(header).isNull(), F.lit("unknown_format"))
        .otherwise(payload_fault(image))
    )


def with_bytes(
    rows: DataFrame,
    image: Column,
    folder: str,
    row_key: Sequence[str],
    pattern: str = "*",
    largest: int = LARGEST_FILE,
) -> DataFrame:
    """Add ``image_bytes``: the image's own, or the whole file that its path names; else null.

    The last step before a model: files are joined by path in a shuffle and never broadcast,
    so leave images out of everything before. A file is copied once for each salt of
    its path, so a path that a third of all rows name gives no task more than its share.
    """
    files = image_files(rows.sparkSession, folder, pattern).where(F.col("length") <= largest)
    table = files.select(path_below(F.col("path"), folder).alias("image_path"), F.col("content").alias("_content"))
    found = salted_join(_keyed(rows, image, folder), table, "image_path", "left", row_key)
    own = F.when(payload_kind(image) == "bytes", image["bytes"])
    return found.select(*rows.columns, F.coalesce(own, F.col("_content")).alias("image_bytes"))
