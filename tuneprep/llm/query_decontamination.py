"""op6: decontamination of documents against benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.decontamination import contaminated
from tuneprep.llm.registry import query, table

SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), windows as (
  select distinct item_id, least(len(ws), 10) as size, array_to_string(ws[i + 1:i + least(len(ws), 10)], ' ') as words
  from b, unnest(range(greatest(len(ws) - 9, least(len(ws), 1)))) as r(i)
), sizes as (
  select distinct size from windows
), found as (
  select g.doc_id, g.p, g.size, windows.item_id
  from (select doc_id, size, i as p, array_to_string(ws[i + 1:i + size], ' ') as words
        from d, sizes, unnest(range(greatest(len(ws) - size + 1, 0))) as r(i)) g
  join windows on g.words = windows.words and g.size = windows.size
), hit as (
  select doc_id, count(distinct p + i) as n_hit from found, unnest(range(size)) as r(i) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from found) group by doc_id
)
select d.doc_id, coalesce(len(ws), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join named using (doc_id)
"""


@query("op6_decontamination", SQL)
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    return contaminated(documents, items).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
