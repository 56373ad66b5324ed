"""Inputs made from the test tables: as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples with null, blank and padded labels, null crops and bad ids."""
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        k.alias("sample_id"),
        (k % 48).cast("int").alias("shard_id"),
        F.when(k % 97 == 0, F.lit(None))
        .when(k % 89 == 0, F.lit("   "))
        .when(k % 83 == 0, F.concat(F.lit("  "), "p_name", F.lit(" ")))
        .otherwise(F.col("p_name"))
        .alias("disease"),
        F.when(k % 13 != 0, F.col("p_type")).alias("crop"),
        F.when(k % 71 == 0, F.lit("x"))
        .when(k % 67 == 0, F.lit("-1"))
        .when(k % 61 == 0, F.lit("5"))
        .alias("label_id"),
    )


def vocab(spark: SparkSession, folder: str) -> DataFrame:
    from tuneprep.operators.vocab import build_vocab

    return build_vocab(table(spark, folder, "part"), "p_name")


def branded(spark: SparkSession, folder: str) -> DataFrame:
    """Samples with many labels, in six chunks of eight shards."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("sample_id"),
        F.floor((F.col("p_partkey") % 48) / 8).cast("int").alias("chunk"),
        F.concat_ws(" ", "p_brand", "p_name").alias("disease"),
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in ten styles for each line item, with the true label."""
    li, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    style = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10
    name = F.col("p_name")
    texts = [
        name,
        F.concat(F.lit("The disease is "), name, F.lit(".")),
        F.concat(F.upper(name), F.lit("\nsecond line")),
        F.replace(name, F.lit(" "), F.lit("-")),
        F.concat(F.lit('Answer: "'), name, F.lit('"')),
        F.concat(name, F.lit(" on the leaf")),
        F.concat(F.lit("severe "), name),
        F.concat(name, F.lit("x")),
        F.lit(""),
    ]
    raw = F.lit("no idea")
    for number, text in enumerate(texts):
        raw = F.when(style == number, text).otherwise(raw)
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"),
        "l_orderkey",
        name.alias("true_label"),
        raw.alias("raw_output"),
    )


def class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """True and predicted classes with confusion and unknown answers."""
    part = F.col("l_partkey")
    return table(spark, folder, "lineitem").select(
        (part % 25).cast("int").alias("true_id"),
        F.when(F.col("l_suppkey") % 11 == 0, F.lit(-1))
        .when(F.col("l_linenumber") % 3 == 0, (part + F.col("l_linenumber")) % 25)
        .otherwise(part % 25)
        .cast("int")
        .alias("pred_id"),
    )


def class_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The classes of ``class_pairs`` and two that never occur."""
    return (
        table(spark, folder, "part")
        .select((F.col("p_partkey") % 27).cast("int").alias("label_id"))
        .distinct()
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of a conversation as the answer of a sample; the role stands for the crop."""
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.col("role").alias("crop"),
        F.col("text").alias("disease"),
        F.lit(0).alias("label_id"),
    )


def token_rows(documents: DataFrame) -> DataFrame:
    """Whole documents as token examples; some are bad, some lack labels."""
    from tuneprep.functions.tokens import mask_prompt, word_ids

    k = F.col("doc_id")
    ids = documents.select(
        "doc_id",
        "batch_id",
        word_ids(F.col("text")).alias("input_ids"),
        (k % 7).cast("int").alias("n_prompt"),
        F.when(k % 31 == 0, F.lit("no_target")).alias("reason"),
    )
    return ids.select(
        "*",
        F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
        F.when(k % 97 != 1, mask_prompt(F.col("input_ids"), F.col("n_prompt"))).alias("labels"),
    )


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as logits of tokens in twenty sequences; some labels are ignored."""
    k = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        (k % 20).cast("int").alias("batch_id"),
        F.floor(k / 20).alias("position"),
        F.col("embedding").alias("logits"),
        F.when(k % 9 == 0, F.lit(-100)).otherwise(F.col("label")).alias("label"),
    )


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as samples of 48 shards, counted."""
    return (
        table(spark, folder, "orders")
        .groupBy((F.col("o_orderkey") % 48).cast("int").alias("shard_id"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """One run per user: each event is an epoch, its value the score."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.row_number().over(order).alias("epoch"),
        F.round(F.col("value") / 1000, 6).alias("macro_f1"),
    )


def batch_log(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as training batches of seven epochs."""
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("epoch"),
        (F.col("l_suppkey") % 6).cast("int").alias("chunk"),
        (F.col("l_extendedprice") / 10000).alias("loss"),
        F.col("l_quantity").cast("bigint").alias("n_rows"),
        (F.col("l_tax") + 0.01).alias("seconds"),
    )


# The same inputs for the oracle. Later entries may use earlier ones.
SQL = {
    "samples": """
      select p_partkey as sample_id, cast(p_partkey % 48 as int) as shard_id,
        case when p_partkey % 97 = 0 then null when p_partkey % 89 = 0 then '   '
             when p_partkey % 83 = 0 then concat('  ', p_name, ' ') else p_name end as disease,
        case when p_partkey % 13 <> 0 then p_type end as crop,
        case when p_partkey % 71 = 0 then 'x' when p_partkey % 67 = 0 then '-1'
             when p_partkey % 61 = 0 then '5' end as label_id
      from part""",
    "vocab": """
      select label, cast(row_number() over (order by label) - 1 as int) as label_id
      from (select distinct p_name as label from part)""",
    "branded": """
      select p_partkey as sample_id, cast((p_partkey % 48) // 8 as int) as chunk,
        p_brand || ' ' || p_name as disease from part""",
    "answers": """
      select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as k, l_orderkey,
        p_name as true_label,
        case (l_orderkey * 7 + l_linenumber) % 10
          when 0 then p_name when 1 then concat('The disease is ', p_name, '.')
          when 2 then concat(upper(p_name), chr(10), 'second line')
          when 3 then replace(p_name, ' ', '-') when 4 then concat('Answer: "', p_name, '"')
          when 5 then concat(p_name, ' on the leaf') when 6 then concat('severe ', p_name)
          when 7 then concat(p_name, 'x') when 8 then '' else 'no idea' end as raw_output
      from lineitem join part on l_partkey = p_partkey""",
    "class_pairs": """
      select cast(l_partkey % 25 as int) as true_id,
        cast(case when l_suppkey % 11 = 0 then -1
                  when l_linenumber % 3 = 0 then (l_partkey + l_linenumber) % 25
                  else l_partkey % 25 end as int) as pred_id
      from lineitem""",
    "class_ids": "select distinct cast(p_partkey % 27 as int) as label_id from part",
    "turns": "select conv_id, turn, role as crop, text as disease, 0 as label_id from conversations",
    "logits": """
      select cast(vec_id % 20 as int) as batch_id, vec_id // 20 as position, embedding as logits,
        case when vec_id % 9 = 0 then -100 else label end as label from embeddings""",
    "shards": """
      select cast(o_orderkey % 48 as int) as shard_id, count(*) as n_rows from orders group by 1""",
    "run_log": """
      select user_id as run_id,
        cast(row_number() over (partition by user_id order by ts, event_id) as int) as epoch,
        round(value / 1000, 6) as macro_f1 from events""",
    "batch_log": """
      select l_linenumber as epoch, cast(l_suppkey % 6 as int) as chunk,
        l_extendedprice / 10000 as loss, cast(l_quantity as bigint) as n_rows,
        l_tax + 0.01 as seconds from lineitem""",
}
