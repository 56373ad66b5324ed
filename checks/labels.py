"""Checks of text rules, vocabulary, row validation and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.oracle import MATCH_STEPS, normalise, statement, strip
from checks.registry import check
from tuneprep.functions import text
from tuneprep.operators import matching, validation, vocab
from tuneprep.operators.joins import lookup_join
from tuneprep.session import materialise, new_path
from tuneprep.sources import vocab_store


def _md5(x: str) -> str:
    return f"md5({x})"


@check(
    "b1_label_check",
    statement(
        f"""select sample_id, case when disease is null then 'missing_label'
              when {strip('disease')} = '' then 'empty_label' end as reason from samples""",
        "samples",
    ),
)
def label_check(spark, folder):
    return fx.samples(spark, folder).select(
        "sample_id", validation.label_fault(F.col("disease")).alias("reason")
    )


@check(
    "b2_clean_crop",
    statement(f"select sample_id, coalesce({strip('crop')}, '') as crop from samples", "samples"),
)
def clean_crop(spark, folder):
    return fx.samples(spark, folder).select(
        "sample_id", validation.clean_crop(F.col("crop")).alias("crop")
    )


RESOLVED = {
    "cleaned": f"""
      select sample_id, {strip('disease')} as label, coalesce({strip('crop')}, '') as crop,
        label_id as given, try_cast(label_id as bigint) as id, disease as raw from samples""",
    "resolved": """
      select sample_id, c.label as disease, crop,
        case when raw is null then 'missing_label' when c.label = '' then 'empty_label'
             when given is not null and id is null then 'bad_id' when id < 0 then 'negative_id'
             when given is not null and v.label_id is not null and v.label_id <> id then 'id_mismatch'
             when given is null and v.label_id is null then 'unknown_label' end as reason,
        case when given is null then 'vocabulary' when v.label_id is null then 'given'
             else 'checked' end as source,
        case when given is null then v.label_id else id end as id
      from cleaned c left join (select * from vocab where label_id % 7 <> 3) v on c.label = v.label""",
}


def _part_vocab(spark, folder):
    """The vocabulary without some labels, so that unknown ones occur."""
    return fx.vocab(spark, folder).where(F.col("label_id") % 7 != 3)


def _resolved(spark, folder):
    return validation.resolve_labels(
        fx.samples(spark, folder), materialise(_part_vocab(spark, folder), "vocab")
    )


@check(
    "b3_resolve_labels",
    statement(
        """select sample_id, disease, crop, reason,
             cast(case when reason is null then id end as int) as label_id,
             case when reason is null then source end as id_source from resolved""",
        "samples",
        "vocab",
        **RESOLVED,
    ),
)
def resolve_labels(spark, folder):
    return _resolved(spark, folder).drop("shard_id")


@check(
    "b4_good_rows",
    statement(
        """select sample_id, disease, crop, cast(id as int) as label_id from resolved
           where reason is null""",
        "samples",
        "vocab",
        **RESOLVED,
    ),
)
def good_rows(spark, folder):
    return validation.good_rows(_resolved(spark, folder)).select(
        "sample_id", "disease", "crop", "label_id"
    )


@check(
    "b4_quarantine",
    statement(
        """select sample_id, disease, reason from resolved where reason is not null""",
        "samples",
        "vocab",
        **RESOLVED,
    ),
)
def quarantine(spark, folder):
    return validation.quarantine(_resolved(spark, folder)).select("sample_id", "disease", "reason")


@check(
    "b4_reason_counts",
    statement(
        """select coalesce(reason, 'ok') as reason, count(*) as n_rows from resolved group by 1""",
        "samples",
        "vocab",
        **RESOLVED,
    ),
)
def reason_counts(spark, folder):
    return validation.reason_counts(_resolved(spark, folder))


@check(
    "d1_build_vocab",
    statement(
        f"""select label, cast(row_number() over (order by label) - 1 as int) as label_id from
              (select distinct {strip('disease')} as label from samples) where label <> ''""",
        "samples",
    ),
)
def build_vocab(spark, folder):
    return vocab.build_vocab(fx.samples(spark, folder))


@check(
    "d2_vocab_from_sample",
    statement(
        """select label, cast(row_number() over (order by label) - 1 as int) as label_id from
             (select distinct disease as label from branded)""",
        "branded",
    ),
)
def vocab_from_sample(spark, folder):
    return vocab.build_vocab_from_sample(fx.branded(spark, folder), "sample_id")


@check("d3_load_or_create", statement("select label, label_id from vocab", "vocab"))
def load_or_create(spark, folder):
    path = new_path(spark, "vocab")
    part = fx.table(spark, folder, "part")
    vocab_store.load_or_create_vocab(part, path, "p_name")
    # The stored one wins: other rows do not change it.
    return vocab_store.load_or_create_vocab(part, path, "p_type")


BASE = """
  select label, cast(row_number() over (order by label) - 1 as int) as label_id from
    (select distinct disease as label from branded where chunk = 0)"""


@check(
    "d4_extend_vocab",
    statement(
        """select * from base union all
           select label, cast((select max(label_id) from base) + row_number() over (order by label)
             as int) as label_id
           from (select distinct disease as label from branded where chunk > 0
                 except select label from base)""",
        "branded",
        base=BASE,
    ),
)
def extend_vocab(spark, folder):
    rows = fx.branded(spark, folder)
    base = vocab.build_vocab(rows.where(F.col("chunk") == 0))
    return vocab.extend_vocab(base, rows.where(F.col("chunk") > 0))


@check(
    "d4_vocab_over_chunks",
    statement(
        """select label, cast(row_number() over (order by chunk, label) - 1 as int) as label_id from
             (select disease as label, min(chunk) as chunk from branded group by 1)""",
        "branded",
    ),
)
def vocab_over_chunks(spark, folder):
    return vocab.vocab_over_chunks(fx.branded(spark, folder), "chunk")


@check(
    "d5_extend_vocab_raw",
    statement(
        f"""select * from base union all
            select label, cast((select max(label_id) from base) + row_number() over (order by raw)
              as int) as label_id
            from (select {strip('raw')} as label, min(raw) as raw from padded group by 1)
            where label not in (select label from base)""",
        "branded",
        base=BASE,
        padded="""select case when sample_id % 3 = 0 then '  ' || disease
                    when sample_id % 3 = 1 then disease || chr(9) else disease end as raw
                  from branded where chunk > 0""",
    ),
)
def extend_vocab_raw(spark, folder):
    rows = fx.branded(spark, folder)
    base = vocab.build_vocab(rows.where(F.col("chunk") == 0))
    key = F.col("sample_id") % 3
    padded = rows.where(F.col("chunk") > 0).withColumn(
        "disease",
        F.when(key == 0, F.concat(F.lit("  "), "disease"))
        .when(key == 1, F.concat("disease", F.lit("\t")))
        .otherwise(F.col("disease")),
    )
    return vocab.extend_vocab(base, padded, order_by="raw")


@check(
    "d6_preflight",
    statement(
        """select (select count(distinct disease) from branded) as n_labels,
             (select count(*) from missing) as n_missing,
             (select string_agg(label, '|' order by label) from
               (select label from missing order by label limit 50)) as preview""",
        "branded",
        base=BASE,
        missing="select distinct disease as label from branded except select label from base",
    ),
)
def preflight(spark, folder):
    rows = fx.branded(spark, folder)
    base = vocab.build_vocab(rows.where(F.col("chunk") == 0))
    return vocab.preflight(base, rows).withColumn("preview", F.array_join("preview", "|"))


FAULTY = """
  select case when p_partkey % 41 = 7 then ' ' else p_brand || ' ' || p_name end as label,
    cast(case when p_partkey % 53 = 9 then -p_partkey else p_partkey // 2 end as int) as label_id
  from part"""


@check(
    "d7_violations",
    statement(
        """select 'empty_label' as rule, cast(label_id as varchar) as detail from entries where label = ''
           union all select 'negative_id', label from entries where label_id < 0
           union all select 'two_ids', label from entries group by label
             having count(distinct label_id) > 1
           union all select 'shared_id', cast(label_id as varchar) from entries group by label_id
             having count(distinct label) > 1
           union all select 'not_contiguous', n || '/' || n_ids || '/' || low || '/' || high from
             (select count(distinct label) as n, count(distinct label_id) as n_ids,
                min(label_id) as low, max(label_id) as high from entries)
             where n > 0 and (low <> 0 or high <> n - 1 or n_ids <> n)""",
        faulty=FAULTY,
        entries=f"select {strip('label')} as label, label_id from faulty",
    ),
)
def vocab_violations(spark, folder):
    k = F.col("p_partkey")
    faulty = fx.table(spark, folder, "part").select(
        F.when(k % 41 == 7, F.lit(" ")).otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("label"),
        F.when(k % 53 == 9, -k).otherwise(F.floor(k / 2)).cast("int").alias("label_id"),
    )
    return vocab.violations(faulty)


@check("d8_inverse_vocab", statement("select label_id, label from vocab", "vocab"))
def inverse_vocab(spark, folder):
    return vocab.inverse_vocab(fx.vocab(spark, folder))


@check(
    "d9_normalised_vocab",
    statement(
        f"""select label, label_id, norm, case when norm = '' then 'empty_after_normalise'
              when count(*) over (partition by norm) > 1 then 'collision' end as fault from
              (select *, {normalise('label')} as norm from spelled)""",
        spelled="""
          select label, cast(row_number() over (order by label) - 1 as int) as label_id from
            (select distinct case when p_partkey % 31 = 3 then upper(p_name) || '!'
               when p_partkey % 37 = 5 then '(' || p_size || '?)'
               when p_partkey % 43 = 6 then '"' || chr(9) || '.'
               else p_brand || '/' || p_name end as label from part)""",
    ),
)
def normalised_vocab(spark, folder):
    k = F.col("p_partkey")
    spelled = fx.table(spark, folder, "part").select(
        F.when(k % 31 == 3, F.concat(F.upper("p_name"), F.lit("!")))
        .when(k % 37 == 5, F.concat(F.lit("("), "p_size", F.lit("?)")))
        .when(k % 43 == 6, F.lit('"\t.'))
        .otherwise(F.concat("p_brand", F.lit("/"), "p_name"))
        .alias("disease")
    )
    return vocab.normalised_vocab(vocab.build_vocab(spelled))


@check(
    "e1_strip",
    statement(
        f"""select doc_id, {_md5('s')} as stripped, cast(length(s) as int) as n_chars from
              (select doc_id, {strip("chr(160) || chr(12) || text || chr(12288) || chr(28)")} as s
               from documents)"""
    ),
)
def strip_text(spark, folder):
    padded = F.concat(F.lit("\xa0\x0c"), "text", F.lit("\u3000\x1c"))
    return fx.table(spark, folder, "documents").select(
        "doc_id",
        F.md5(text.strip(padded)).alias("stripped"),
        F.length(text.strip(padded)).alias("n_chars"),
    )


@check(
    "e2_normalise_answers",
    statement(f"select k, {normalise('raw_output')} as norm from answers", "answers"),
)
def normalise_answers(spark, folder):
    return fx.answers(spark, folder).select(
        "k", text.normalise_label(F.col("raw_output")).alias("norm")
    )


@check(
    "e2_normalise_documents",
    statement(
        f"""select doc_id, {normalise("'Answer: the DISEASE is ' || text")} as norm from documents"""
    ),
)
def normalise_documents(spark, folder):
    return fx.table(spark, folder, "documents").select(
        "doc_id",
        text.normalise_label(F.concat(F.lit("Answer: the DISEASE is "), "text")).alias("norm"),
    )


@check(
    "e3_match_exact",
    statement(
        """select k, a.p as normalised, coalesce(f.label, 'Unknown') as predicted_label,
             coalesce(f.label_id, -1) as predicted_id,
             case when f.label is null then 'unknown' else 'valid_normalized' end as status
           from asked a left join forms f on a.p = f.norm""",
        "answers",
        "vocab",
        forms=MATCH_STEPS["forms"],
        asked=MATCH_STEPS["asked"],
    ),
)
def match_exact(spark, folder):
    return matching.match_predictions(
        fx.answers(spark, folder), fx.vocab(spark, folder), row_key=["k"], containment=False
    ).select("k", "normalised", "predicted_label", "predicted_id", "status")


@check(
    "e4_match_containment",
    statement(
        "select k, predicted_label, predicted_id, status from matched",
        "answers",
        "vocab",
        **MATCH_STEPS,
    ),
)
def match_containment(spark, folder):
    return matching.match_predictions(
        fx.answers(spark, folder), fx.vocab(spark, folder), row_key=["k"]
    ).select("k", "predicted_label", "predicted_id", "status")


NESTED = """
  select label, cast(row_number() over (order by label) - 1 as int) as label_id from
    (select distinct unnest([p_name, split_part(p_name, ' ', 1), 'severe ' || p_name]) as label
     from part)"""


def _nested(spark, folder):
    """Labels that contain each other."""
    name = F.col("p_name")
    labels = F.array(name, F.substring_index(name, " ", 1), F.concat(F.lit("severe "), name))
    return vocab.build_vocab(
        fx.table(spark, folder, "part").select(F.explode(labels).alias("label")), "label"
    )


@check(
    "e4_match_nested_shuffled",
    statement(
        "select k, predicted_label, predicted_id, status from matched",
        "answers",
        vocab=NESTED,
        **MATCH_STEPS,
    ),
)
def match_nested_shuffled(spark, folder):
    """The way a vocabulary beyond the broadcast bound goes."""
    return matching.match_predictions(
        fx.answers(spark, folder), _nested(spark, folder), row_key=["k"], max_rows=0
    ).select("k", "predicted_label", "predicted_id", "status")


@check(
    "e4_match_longest",
    statement(
        "select k, predicted_label, predicted_id, status from matched",
        "answers",
        vocab=NESTED,
        **MATCH_STEPS
        | {
            "ranked": MATCH_STEPS["ranked"].replace(
                "1 end, label_id)", "1 end, length(norm) desc, label_id)"
            )
        },
    ),
)
def match_longest(spark, folder):
    return matching.match_predictions(
        fx.answers(spark, folder), _nested(spark, folder), row_key=["k"], longest=True
    ).select("k", "predicted_label", "predicted_id", "status")


@check(
    "b3_salted_lookup",
    statement(
        """select k, true_label, label_id as true_id from answers
           left join vocab on true_label = label""",
        "answers",
        "vocab",
    ),
)
def salted_lookup(spark, folder):
    """The join with a vocabulary beyond the broadcast bound."""
    table = fx.vocab(spark, folder).select(
        F.col("label").alias("true_label"), F.col("label_id").alias("true_id")
    )
    rows = fx.answers(spark, folder).select("k", "true_label")
    return lookup_join(rows, table, "true_label", "left", ["k"], max_rows=0)


@check("a11_vocab_json", statement("select label, label_id from vocab", "vocab"))
def vocab_json(spark, folder):
    path = new_path(spark, "labels-json")
    vocab_store.write_vocab_json(fx.vocab(spark, folder), path)
    return vocab_store.read_vocab_json(spark, path)


@check("a11_vocab_versions", statement("select label, label_id from vocab", "vocab"))
def vocab_versions(spark, folder):
    path = new_path(spark, "vocab")
    full = fx.vocab(spark, folder)
    vocab_store.save_vocab(full.where(F.col("label_id") < 2), path, 0)
    vocab_store.save_vocab(full, path, 7)
    return vocab_store.load_vocab(spark, path)
