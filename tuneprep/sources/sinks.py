"""Predictions, metrics and run logs as files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tuneprep.session import materialise

PREDICTION_SCHEMA = (
    "index bigint, true_label string, true_id int, predicted_label string, predicted_id int, "
    "status string, correct boolean, raw_model_output string"
)
PREDICTION_FIELDS = [field.split()[0] for field in PREDICTION_SCHEMA.split(", ")]
_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def prediction_rows(
    df: DataFrame, index: Column, raw_col: str = "raw_output"
) -> DataFrame:
    """Scored predictions in the eight fields of the prediction file."""
    return df.select(
        index.cast("bigint").alias("index"),
        "true_label",
        F.col("true_id").cast("int").alias("true_id"),
        "predicted_label",
        F.col("predicted_id").cast("int").alias("predicted_id"),
        "status",
        (F.col("true_id") == F.col("predicted_id")).alias("correct"),
        F.col(raw_col).alias("raw_model_output"),
    )


def write_predictions(predictions: DataFrame, path: str) -> None:
    """CSV with a header, every text quoted, so that answers may span lines."""
    (
        predictions.select(*PREDICTION_FIELDS)
        .write.mode("overwrite")
        .options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction file; an empty answer comes back as the empty text."""
    df = spark.read.schema(PREDICTION_SCHEMA).options(**_CSV).option("mode", "FAILFAST").csv(path)
    return df.na.fill("", ["raw_model_output"])


def write_metrics(
    metrics: DataFrame,
    path: str,
    checkpoint: str | None = None,
    validation_shard: int | str | None = None,
) -> None:
    """Metrics (one row) or debug rows as JSON, nulls included.

    ``checkpoint`` and ``validation_shard`` say what was evaluated on what, so that two
    files can be told apart.
    """
    about = {"checkpoint": checkpoint, "validation_shard": validation_shard}
    record = metrics.withColumns({k: F.lit(v) for k, v in about.items() if v is not None})
    record.write.mode("overwrite").option("ignoreNullFields", False).json(path)


_LOG_KEYS = ["run_id", "epoch"]


def _log_columns(names: list[str]) -> list[str]:
    """The order of the columns of a log file, whatever the order of the frame."""
    return sorted(set(names) - set(_LOG_KEYS)) + _LOG_KEYS


def _log_reader(spark: SparkSession, schema: StructType):
    """Reads log files by the names in their headers; other columns are an error, not shifted values."""
    reader = spark.read.schema(schema).option("header", True)
    return reader.option("enforceSchema", False).option("mode", "FAILFAST")


def append_run_log(rows: DataFrame, path: str) -> None:
    """Add epoch rows to the log; a resumed run keeps its earlier epochs, one that is run again replaces its own.

    Only the files of the runs that the rows belong to are written anew.
    """
    spark, new = rows.sparkSession, rows.select(*_log_columns(rows.columns))
    try:
        old = _log_reader(spark, new.schema).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = new
    else:
        kept = old.join(new.select("run_id").distinct(), "run_id", "left_semi")
        kept = kept.join(new.select(*_LOG_KEYS), _LOG_KEYS, "left_anti")
        merged = materialise(new.unionByName(kept), "run-log")
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("run_id")
        .csv(path)
    )


def read_run_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log in the columns of the schema."""
    fields = {f.name: f for f in StructType.fromDDL(schema).fields}
    stored = StructType([fields[c] for c in _log_columns(list(fields))])
    return _log_reader(spark, stored).csv(path).select(*fields)
