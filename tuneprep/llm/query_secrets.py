"""op8: secrets in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.registry import query, table
from tuneprep.llm.secret_scan import ACCESS, ASSIGN, HEX, listed, scan


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    counts = {f"n_{kind}": of(kind) for kind in (ASSIGN, ACCESS, HEX)}
    return found.select(
        "doc_id",
        *(c.alias(name) for name, c in counts.items()),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
