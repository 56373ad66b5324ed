"""op9: Jaccard join of documents on word 3-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.jaccard import similar
from tuneprep.llm.registry import query, table

SQL = r"""
with recursive d as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct r, array_to_string(ws[i + 1:i + 3], ' ') as g
  from d, unnest(range(greatest(len(ws) - 2, least(len(ws), 1)))) as u(i)
), n as (
  select r, count(*) as n from s group by r
), links as (
  select a, b from (select x.r as a, y.r as b, count(*) as shared from s x join s y on x.g = y.g and x.r <> y.r group by all)
  join n na on na.r = a join n nb on nb.r = b
  where 100 * shared >= 90 * (na.n + nb.n - shared)
), reach as (
  select r, r as other from d
  union
  select reach.r, b from reach join links on reach.other = a
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from d left join n using (r)
join (select reach.r, min(o.doc_id) as component_id from reach join d o on o.r = other group by reach.r) using (r)
"""


@query("op9_ngram_jaccard", SQL)
def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return similar(documents).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
