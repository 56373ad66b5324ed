"""op10: near-duplicate embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.cover_tree import near_duplicates
from tuneprep.llm.registry import query, table

SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
), u as materialized (
  select vec_id, e from v
  where e is not null and len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0
    and len([x for x in e if x <> 0]) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from u x join u y
  on x.vec_id <> y.vec_id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.9
), reach as (
  select vec_id, vec_id as other from v
  union
  select reach.vec_id, b from reach join links on reach.other = a
), named as (
  select vec_id, min(other) as component_id from reach group by vec_id
)
select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept
from named
"""


@query("op10_cover_tree", SQL)
def op10_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return near_duplicates(vectors).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
