"""op12: codes of embeddings."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.codes import ROUNDS, encode, fit, integers
from tuneprep.llm.registry import query, table
from tuneprep.operators.joins import lookup_join
from tuneprep.session import materialise


def _round(k: int) -> str:
    """Assign all parts to codebook k."""
    return f"""
a{k} as materialized (
  select r, part, vals, entry, dist from (
    select r, p.part, p.vals, b.entry,
           list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.vals, b.vals)])::bigint as dist
    from p join b{k} b on p.part = b.part)
  qualify row_number() over (partition by r, part order by dist, entry) = 1
)"""


def _means(k: int) -> str:
    """Codebook k from the assignment to the one before; entries without parts stay."""
    return f"""
b{k} as materialized (
  select o.part, o.entry, coalesce(n.vals, o.vals) as vals from b{k - 1} o left join (
    select part, entry, list(mean order by i) as vals from (
      select part, entry, i, floor(sum(vals[i]) / count(*)::double)::bigint as mean
      from a{k - 1}, unnest(range(1, len(vals) + 1)) as u(i) group by part, entry, i)
    group by part, entry) n on o.part = n.part and o.entry = n.entry
)"""


SQL = f"""
with sound as (
  select vec_id, label, embedding::double[] as e from embeddings
  where len(embedding) > 0 and len(embedding) % 8 = 0
    and len([x for x in embedding::double[] if x is null or not isfinite(x)]) = 0
), v as materialized (
  select row_number() over () as r, vec_id, label, [floor(4096 * x)::bigint for x in e] as c from sound
  where len(e) = (select len(e) from sound order by vec_id nulls last, len(e) limit 1)
), p as materialized (
  select r, part, c[part * (len(c) // 8) + 1:(part + 1) * (len(c) // 8)] as vals from v, unnest(range(8)) as u(part)
), seeds as (
  select r, row_number() over (order by vec_id nulls last, c) - 1 as entry from v qualify entry < 16
), b0 as materialized (
  select part, entry, vals from p join seeds using (r)
), {", ".join(_round(k) + "," + _means(k + 1) for k in range(ROUNDS))}, {_round(ROUNDS)}, coded as materialized (
  select r, string_agg(printf('%02x', entry), '' order by part) as code, sum(dist)::bigint as error from a{ROUNDS} group by r
), books as (
  select sha256(string_agg(array_to_string(vals, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS}
)
select v.vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join v using (r), books
"""


@query("op12_vector_codes", SQL)
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    vectors = materialise(integers(rows), "vectors")
    codebooks = fit(vectors)
    # Labels as text that is never null, so that rows without a label meet too.
    coded = encode(vectors, codebooks).select("id", F.to_json(F.struct("label")).alias("label"), "code", "error")
    coded = materialise(coded, "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    numbers = ",".join(str(x) for book in codebooks for entry in book.tolist() for x in entry)
    return lookup_join(coded, totals, "label", "inner", ["id", "code"]).select(
        F.col("id").alias("vec_id"),
        "code",
        "error",
        "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )
