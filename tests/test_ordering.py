import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tuneprep.operators import ordering, splits


def seeded(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_rank_is_exact(spark, digits):
    df = spark.range(500).withColumn("h", ordering.seeded_hash(9, "id"))
    got = {r["id"]: r["rank"] for r in ordering.hash_rank(df, "h", digits=digits).collect()}
    order = sorted(range(500), key=lambda i: seeded(9, i))
    assert [got[i] for i in order] == list(range(1, 501))


@pytest.mark.parametrize("n", [0, 1, 17, 500, 900])
def test_cut_takes_n(spark, n):
    taken = splits.take_seeded(spark.range(500), ["id"], n, seed=4)
    order = sorted(range(500), key=lambda i: seeded(4, i))
    assert {r["id"] for r in taken.collect()} == set(order[:n])


@pytest.mark.parametrize("rows, fraction", [(500, 0.15), (3, 0.15), (20, 0.15), (40, 1.0), (0, 0.5)])
def test_fraction_sizes(spark, rows, fraction):
    split = splits.fraction_split(spark.range(rows), ["id"], fraction)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes.get("val", 0) == int(rows * fraction)
    assert sum(sizes.values()) == rows


def test_approximate_split_is_near(spark):
    split = splits.fraction_split(spark.range(20000), ["id"], 0.15, mode="approx")
    assert abs(split.where("split = 'val'").count() - 3000) < 200


def test_samples_are_disjoint_and_repeat(spark):
    def made():
        out = splits.disjoint_samples(spark.range(300), ["id"], {"train": 200, "val": 50}, seed=1)
        return sorted((r["id"], r["split"]) for r in out.collect())

    rows = made()
    assert rows == made()
    assert len({i for i, _ in rows}) == 250
    assert [s for _, s in rows].count("val") == 50


def test_shuffle_and_batches(spark):
    first = splits.assign_batches(splits.shuffled(spark.range(103), ["id"], epoch=1), 10)
    sizes = {r["batch_id"]: r["count"] for r in first.groupBy("batch_id").count().collect()}
    assert sizes == {**{i: 10 for i in range(10)}, 10: 3}
    other = splits.shuffled(spark.range(103), ["id"], epoch=2)
    assert sorted(r["position"] for r in other.collect()) == list(range(103))
    assert first.select("id", "position").exceptAll(other).count() > 50


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values_with_a_hot_group(spark, inclusive):
    rng = random.Random(8)
    rows = [("hot", i, rng.randint(0, 99)) for i in range(700)]
    rows += [(f"g{i % 5}", i * 3, rng.randint(0, 99)) for i in range(100)] + [(None, 4, 1), (None, 9, 2)]
    df = spark.createDataFrame(rows, "g string, pos long, x int")
    values = {"total": ("sum", F.col("x")), "top": ("max", F.col("x"))}
    got = ordering.running(df, ["g"], "pos", values, inclusive, rows_per_bucket=13)
    found = {(r["g"], r["pos"]): (r["total"], r["top"]) for r in got.collect()}
    expected = {}
    for group in {r[0] for r in rows}:
        seen = []
        for g, pos, x in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            before = list(seen)
            seen.append(x)
            used = seen if inclusive else before
            expected[(g, pos)] = (sum(used), max(used)) if used else (None, None)
    assert found == expected


def test_shard_splits(spark):
    splits.check_ranges(splits.SHARD_SPLITS)
    with pytest.raises(splits.SplitError, match="share shard 36"):
        splits.check_ranges({"train": (0, 36), "val": (36, 41)})
    got = spark.range(50).select("id", splits.shard_split(F.col("id")).alias("s")).collect()
    names = [r["s"] for r in sorted(got)]
    assert names == ["train"] * 36 + ["val"] * 6 + ["test"] * 6 + [None] * 2


def test_chunk_plan(spark):
    shards = spark.range(36).withColumnRenamed("id", "shard_id")
    groups = splits.chunk_groups(splits.chunk_plan(shards, chunk_size=2)).collect()
    assert [r["shards"] for r in sorted(groups)] == [[i, i + 1] for i in range(0, 36, 2)]
    short = splits.chunk_groups(splits.chunk_plan(shards, chunk_size=5, max_chunks=0))
    assert {r["chunk"]: r["n_shards"] for r in short.collect()}[8] == 1
    assert splits.chunk_plan(shards, chunk_size=5, max_chunks=3).count() == 15
    with pytest.raises(splits.SplitError):
        splits.chunk_plan(shards, chunk_size=0)


def test_first_rows(spark):
    assert splits.first_rows(spark.range(5), ["id"], None).count() == 5
    assert [r["id"] for r in splits.first_rows(spark.range(9), ["id"], 2).collect()] == [0, 1]
    assert splits.first_rows(spark.range(3), ["id"], 9).count() == 3
