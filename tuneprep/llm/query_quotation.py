"""op4: conversations in reply order, without quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm import quotation as Q
from tuneprep.llm.registry import query, table

SQL = rf"""
with recursive messages as (
  select row_number() over () as id, * from conversations
), lines as (
  select id, conv_id, turn, line, place, length(regexp_extract(line, '{Q.MARKS}')) - length(replace(regexp_extract(line, '{Q.MARKS}'), '>', '')) as level,
         trim(regexp_replace(translate(regexp_replace(line, '{Q.MARKS}', ''), '{Q.UPPER}', '{Q.LOWER}'), '[ \t\x0B\f\r]+', ' ', 'g'), ' ') as words
  from (select id, conv_id, turn, unnest(ls) as line, unnest(range(len(ls))) as place
        from (select id, conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) as ls from messages))
  where not regexp_matches(line, '{Q.ATTRIBUTION}')
), own as (
  select id, trim(string_agg(line, chr(10) order by place), ' ' || chr(9) || chr(10)) as text from lines where level = 0 group by id
), runs as (
  select *, sum(case when words <> '' and words_before <> '' and level = level_before then 0 else 1 end) over (partition by id order by place) as run
  from (select *, lag(words) over w as words_before, lag(level) over w as level_before from lines window w as (partition by id order by place))
), passages as (
  select id, conv_id, turn, level, words from runs where words <> ''
  union
  select id, conv_id, turn, level, string_agg(words, ' ' order by place) from runs where words <> '' group by id, conv_id, turn, level, run
), origins as (
  select conv_id, words, min(turn) as origin from passages where level = 0 and conv_id is not null and turn is not null group by all
), quotes as (
  select id, p.conv_id, p.turn, level, case when origin < p.turn then origin end as origin
  from passages p left join origins using (conv_id, words) where level > 0
), parents as (
  select id, count(*) as n_quotes, count(origin) as n_linked from quotes group by id
), chosen as (
  select id, conv_id, turn, max(origin) as quoted from quotes q
  where origin is not null and level = (select min(level) from quotes r where r.id = q.id and r.origin is not null) group by all
), replies as (
  select conv_id, turn, max(quoted) as parent from chosen group by all
), walk as (
  select conv_id, turn, parent as thread, 1 as depth from replies
  union all
  select w.conv_id, w.turn, r.parent, w.depth + 1 from walk w join replies r on r.conv_id = w.conv_id and r.turn = w.thread
), threads as (
  select conv_id, turn, min(thread) as thread, max(depth) as depth from walk group by all
)
select m.conv_id, m.turn, m.role, coalesce(own.text, '') as text,
       coalesce(quoted, (select max(turn) from messages b where b.conv_id = m.conv_id and b.turn < m.turn)) as parent_turn,
       quoted is not null as quoted, coalesce(thread, m.turn) as thread, coalesce(depth, 0)::bigint as depth,
       coalesce(n_quotes, 0)::bigint as n_quotes, coalesce(n_linked, 0)::bigint as n_linked,
       case when m.conv_id is not null and m.turn is not null
         then rank() over (partition by m.conv_id, m.turn is null order by coalesce(thread, m.turn), m.turn) - 1 end as position
from messages m left join own using (id) left join parents using (id) left join chosen using (id)
left join threads t on t.conv_id = m.conv_id and t.turn = m.turn
"""


@query("op4_quotation_links", SQL)
def op4_quotation_links(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "conversations").select(F.col("conv_id").alias("conversation"), "turn", "role", "text")
    return Q.link(messages).withColumnsRenamed({"conversation": "conv_id", "parent": "parent_turn"})
