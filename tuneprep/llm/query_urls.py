"""op2: verdicts on the urls of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.registry import query, table
from tuneprep.llm.url_filter import judge


@query("op2_link_trust")
def op2_link_trust(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("id"), "url", "html")
    return judge(pages).withColumnRenamed("id", "page_id")
