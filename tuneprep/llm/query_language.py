"""op3: language of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.language import fit, identify
from tuneprep.llm.registry import query, table
from tuneprep.llm.sampling import remainder




@query("op3_language")
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    net = fit(documents.where(remainder("id", 4) != 2))
    return identify(documents.select("id", "text"), net).select(
        F.col("id").alias("doc_id"), F.coalesce(remainder("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
