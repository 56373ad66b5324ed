"""Small files on any file system that Spark knows: lists, and publishing a file only once."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The path as a task can open it itself, if it is on a local or mounted disk; else None."""
    target, fs = _file_system(spark, path)
    uri = fs.makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def make_folder(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.mkdirs(target)


def names(spark: SparkSession, path: str, folders: bool = False) -> list[str]:
    """Names of the files (or folders) in a folder, in order; none if it does not exist."""
    target, fs = _file_system(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory() == folders)


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _file_system(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder or file, if it is there."""
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; False if the file is there already, whoever made it.

    The text is written under another name and renamed without replacing, so a reader
    sees all of it or nothing, and of two writers one succeeds. That is as exclusive as
    the rename of the file system: one step on HDFS and its like, a look and
    a step on a local disk.
    """
    target, fs = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    draft = f"{target.getParent().toString()}/.{target.getName()}.{uuid.uuid4().hex}"
    stream = fs.create(_file_system(spark, draft)[0], True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    return rename_new(spark, draft, path)


def rename_new(spark: SparkSession, draft: str, path: str) -> bool:
    """Give a finished draft, a file or a folder, its name; False if the name is taken. The draft is then removed."""
    source, fs = _file_system(spark, draft)
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    target = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    try:
        context.rename(fs.makeQualified(source), target, options)
    except Py4JJavaError as error:
        fs.delete(source, True)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
