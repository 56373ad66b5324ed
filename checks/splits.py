"""Checks of splits, chunk plans, seeded orders and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.oracle import statement
from checks.registry import check
from tuneprep.operators import splits

SPLIT = """case when shard_id between 0 and 35 then 'train' when shard_id between 36 and 41 then 'val'
  when shard_id between 42 and 47 then 'test' end"""


@check(
    "c1_shard_split",
    statement(f"select sample_id, shard_id, {SPLIT} as split from samples", "samples"),
)
def shard_split(spark, folder):
    return fx.samples(spark, folder).select(
        "sample_id", "shard_id", splits.shard_split(F.col("shard_id")).alias("split")
    )


@check(
    "c2_shard_overlap",
    statement(
        """select shard_id, min(split) as first_split, max(split) as last_split from assigned
           group by 1 having count(distinct split) > 1""",
        "shards",
        assigned=f"""
          select shard_id, {SPLIT} as split from shards union all
          select shard_id, case when shard_id <= 37 then 'train' else 'val' end from shards""",
    ),
)
def shard_overlap(spark, folder):
    shards = fx.shards(spark, folder).select("shard_id")
    other = {"train": (0, 37), "val": (38, 47)}
    ours = shards.select("shard_id", splits.shard_split(F.col("shard_id")).alias("split"))
    theirs = shards.select("shard_id", splits.shard_split(F.col("shard_id"), other).alias("split"))
    return splits.split_overlap(ours.unionByName(theirs), "shard_id")


@check(
    "c2_text_leak",
    statement(
        """select text_hash, min(split) as first_split, max(split) as last_split from
             (select md5(text) as text_hash, case when doc_id % 5 = 0 then 'val' else 'train' end
                as split from documents) group by 1 having count(distinct split) > 1"""
    ),
)
def text_leak(spark, folder):
    """Texts that stand in both splits; only their hashes are shuffled."""
    assigned = fx.table(spark, folder, "documents").select(
        F.md5("text").alias("text_hash"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("val")).otherwise(F.lit("train")).alias("split"),
    )
    return splits.split_overlap(assigned, "text_hash")


PLAN = """
  select shard_id, n_rows, cast((row_number() over (order by shard_id) - 1) // 5 + 1 as int) as chunk
  from shards where shard_id <= 35"""


def train_plan(spark, folder, chunk_size=5):
    train = fx.shards(spark, folder).where(
        splits.shard_split(F.col("shard_id")) == F.lit("train")
    )
    return splits.chunk_plan(train, "shard_id", chunk_size)


@check("c3_chunk_plan", statement("select * from plan", "shards", plan=PLAN))
def chunk_plan(spark, folder):
    return train_plan(spark, folder)


@check(
    "c3_chunk_groups",
    statement(
        """select chunk, string_agg(shard_id, ',' order by shard_id) as shards, count(*) as n_shards
           from plan group by 1""",
        "shards",
        plan=PLAN,
    ),
)
def chunk_groups(spark, folder):
    return splits.chunk_groups(train_plan(spark, folder)).withColumn(
        "shards", F.array_join(F.col("shards").cast("array<string>"), ",")
    )


@check(
    "c4_exact_split",
    statement(
        """select o_orderkey, case when row_number() over (order by md5('42:' || o_orderkey))
             <= floor((select count(*) from orders) * 0.15::double) then 'val' else 'train' end as split
           from orders"""
    ),
)
def exact_split(spark, folder):
    return splits.fraction_split(fx.table(spark, folder, "orders"), ["o_orderkey"]).select(
        "o_orderkey", "split"
    )


@check(
    "c4_approx_split",
    statement(
        """select o_orderkey, case when ('0x' || substr(md5('7:' || o_orderkey), 1, 8))::bigint
             < cast(floor(0.15::double * 4294967296) as bigint) then 'val' else 'train' end as split
           from orders"""
    ),
)
def approx_split(spark, folder):
    return splits.fraction_split(
        fx.table(spark, folder, "orders"), ["o_orderkey"], seed=7, mode="approx"
    ).select("o_orderkey", "split")


@check(
    "c5_seeded_shuffle",
    statement(
        """select o_orderkey, row_number() over (order by md5('42:3:' || o_orderkey)) - 1 as position
           from orders"""
    ),
)
def seeded_shuffle(spark, folder):
    orders = fx.table(spark, folder, "orders").select("o_orderkey")
    return splits.shuffled(orders, ["o_orderkey"], seed=42, epoch=3)


@check(
    "c6_disjoint_samples",
    statement(
        """select o_orderkey, case when place <= 800 then 'train' else 'val' end as split from
             (select o_orderkey, row_number() over (order by md5('42:' || o_orderkey)) as place
              from orders) where place <= 1000"""
    ),
)
def disjoint_samples(spark, folder):
    return splits.disjoint_samples(
        fx.table(spark, folder, "orders"), ["o_orderkey"], {"train": 800, "val": 200}
    ).select("o_orderkey", "split")


@check(
    "c7_batches",
    statement(
        """select o_orderkey, position, position // 16 as batch_id from
             (select o_orderkey, row_number() over (order by md5('42:0:' || o_orderkey)) - 1
                as position from orders)"""
    ),
)
def batches(spark, folder):
    orders = fx.table(spark, folder, "orders").select("o_orderkey")
    return splits.assign_batches(splits.shuffled(orders, ["o_orderkey"]), 16)


@check(
    "c8_remaining_chunks",
    statement(
        """select * from plan where chunk not in
             (select l_linenumber from lineitem where l_suppkey % 2 = 0)""",
        "shards",
        plan=PLAN,
    ),
)
def remaining_chunks(spark, folder):
    """Line items stand for the manifest: epoch by supplier, chunk by line."""
    manifest = fx.table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 2).alias("epoch"), F.col("l_linenumber").alias("chunk")
    )
    return splits.remaining_chunks(train_plan(spark, folder), manifest, epoch=0)


@check("b10_first_rows", statement("select * from orders order by o_orderkey limit 1000"))
def first_rows(spark, folder):
    return splits.first_rows(fx.table(spark, folder, "orders"), ["o_orderkey"], 1000)


@check(
    "b10_first_by_key",
    statement("select * from orders order by o_custkey, o_orderkey limit 1000"),
)
def first_by_key(spark, folder):
    """The same cap where rows are too wide to be ordered."""
    return splits.first_by_key(fx.table(spark, folder, "orders"), ["o_custkey", "o_orderkey"], 1000)
