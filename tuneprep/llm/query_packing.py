"""op7: packing of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.packing import pack, pieces
from tuneprep.llm.registry import query, table


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    packed = pack(pieces(documents, public_tokenizers.path("byte_bpe_50k.json")))
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"
    )
