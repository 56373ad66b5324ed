"""op13: quality of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.quality import CUT, fit, score
from tuneprep.llm.registry import query, table
from tuneprep.llm.sampling import remainder


@query("op13_quality")
def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    held_out = remainder("id", 5) == 0
    model = fit(documents, labels.where(~held_out))
    return score(documents, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
