"""op5: licences of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm import licenses as L
from tuneprep.llm.registry import query, table


def _pattern(sequence: list[str]) -> str:
    """A pattern over identifiers, each between commas, that this ordered sequence fits; the oracle's engine has no stack to overflow."""
    return "," + "(?:[^,]+,)*?".join(f"{x}," for x in sequence)


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in L.SENTENCES.items())
    rules = ", ".join(f"({n}, '{name}', '{_pattern(seq)}')" for n, (name, seq) in enumerate(L.RULES, 1))
    implied = " or ".join(f"(name = '{n}' and list_contains(names, '{by}'))" for n, by in L.IMPLIED.items())
    return rf"""
with known(sentence, id) as (values {known}), rules(number, name, pattern) as (values {rules}), cut as (
  select doc_id, trim(regexp_replace(translate(s, '{L.UPPER}', '{L.LOWER}'), '{L.OTHER}', ' ', 'g'), ' ') as sentence, place
  from (select doc_id, unnest(parts) as s, unnest(range(len(parts))) as place
        from (select doc_id, string_split(regexp_replace(text, '{L.BREAK}', '\1' || chr(10), 'g'), chr(10)) as parts from documents))
), ids as (
  select doc_id, string_agg(id, ',' order by place) as ids from cut join known using (sentence) group by doc_id
), fits as (
  select doc_id, name, min(number) as rule from ids join rules on regexp_matches(',' || ids || ',', pattern) group by all
), named as (
  select doc_id, name, rule, list(name) over (partition by doc_id) as names from fits
), kept as (
  select doc_id, string_agg(name, ',' order by rule) as licenses, string_agg(rule::varchar, ',' order by rule) as rules
  from named where not ({implied}) group by doc_id
)
select doc_id, coalesce(ids, '') as sentence_ids, coalesce(rules, '') as rules, coalesce(licenses, '') as licenses
from documents left join ids using (doc_id) left join kept using (doc_id)
"""


@query("op5_license_scan", _sql())
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = L.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.transform("rules", lambda x: x.cast("string")), ",").alias("rules"),
        F.array_join("licenses", ",").alias("licenses"),
    )
