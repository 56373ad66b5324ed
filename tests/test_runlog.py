import random

import pytest
from pyspark.sql import functions as F

from tuneprep.operators import runlog


def log(spark, runs):
    rows = [(run, i, float(s)) for run, scores in runs.items() for i, s in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "run_id string, epoch int, macro_f1 double")


def by_loop(scores, patience):
    """Best epoch, its score, and the last epoch that was trained."""
    best, best_epoch, idle = -1.0, -1, 0
    for epoch, score in enumerate(scores, 1):
        if score > best:
            best, best_epoch, idle = score, epoch, 0
        else:
            idle += 1
            if idle >= patience:
                return best_epoch, best, epoch, True
    return best_epoch, best, len(scores), False


RUNS = {
    "tie": [0.5, 0.5, 0.6, 0.6, 0.6],
    "up": [0.1, 0.2, 0.3],
    "down": [0.9, 0.8, 0.7, 0.95],
    "nan": [float("nan"), 0.2, float("nan"), 0.3],
    "nothing": [-1.0, -2.0],
    "late": [0.3, 0.2, 0.4, 0.1, 0.1, 0.9],
}


def test_best_epoch(spark):
    got = {r["run_id"]: (r["best_epoch"], r["best_macro_f1"]) for r in runlog.best_epoch(log(spark, RUNS)).collect()}
    assert got == {run: by_loop(s, 10**6)[:2] for run, s in RUNS.items()}


@pytest.mark.parametrize("patience", [1, 2, 3])
def test_early_stop(spark, patience):
    rng = random.Random(patience)
    runs = RUNS | {f"r{i}": [rng.randint(0, 9) / 9 for _ in range(rng.randint(1, 30))] for i in range(40)}
    rows = runlog.early_stop(log(spark, runs), patience, rows_per_bucket=4).collect()
    for run, scores in runs.items():
        kept = sorted((r for r in rows if r["run_id"] == run), key=lambda r: r["epoch"])
        _, _, last, stopped = by_loop(scores, patience)
        assert [r["epoch"] for r in kept] == list(range(1, last + 1))
        assert [r["stopped"] for r in kept] == [False] * (last - 1) + [stopped]
        best = -1.0
        for r in kept:
            assert r["improved"] == (scores[r["epoch"] - 1] > best)
            if r["improved"]:
                best = scores[r["epoch"] - 1]


def test_resume(spark):
    rows = [
        ("mid", 2, 5, 18, False, 1), ("mid", 2, 6, 18, False, 2),
        ("done", 1, 18, 18, True, 9),
        ("unvalidated", 3, 18, 18, False, 4),
        ("other", 1, 3, 17, False, 1),
        ("fresh", 0, 2, 18, False, 1),
    ]
    manifest = spark.createDataFrame(
        rows, "run_id string, epoch int, chunk int, total_chunks int, validated boolean, written_at int"
    )
    got = {r["run_id"]: tuple(r)[1:] for r in runlog.resume_position(manifest, 18).collect()}
    assert got == {
        "mid": (2, 7, False, None),
        "done": (2, 1, False, None),
        "unvalidated": (4, 1, True, None),
        "other": (1, 4, False, "chunk_total_changed"),
        "fresh": (1, 3, False, None),
    }


def test_budget_of_the_published_settings(spark):
    """18 chunks of two shards, 15,900 rows each, batch 16, accumulation 2, 3 epochs."""
    chunks = spark.range(1, 19).select(F.col("id").alias("chunk"), F.lit(31800).alias("n_rows"))
    budget = runlog.step_budget(chunks, 16, 2, epochs=3, warmup_ratio=0.05).first()
    assert tuple(budget) == (17892, 53676, 2683)
    assert runlog.chunk_steps(chunks, 16, 2).select("n_batches", "n_steps").distinct().collect() == [(1988, 994)]
    unmeasured = chunks.withColumn("n_rows", F.lit(None).cast("int"))
    assert tuple(runlog.step_budget(unmeasured, 16, 2, 3, 0.05, estimate=31800).first()) == tuple(budget)
    assert runlog.step_budget(chunks.limit(0), 16, 2, 3, 0.05).first()["total_steps"] == 1


def test_accumulation(spark):
    chunks = spark.createDataFrame([(1, 70), (2, 16), (3, 0)], "chunk int, n_rows long")
    rows = sorted(runlog.accumulation_plan(chunks, 16, 3).collect())
    assert [tuple(r) for r in rows] == [(1, 5, 2, 2, 1.5), (2, 1, 1, 1, 3.0)]


def test_schedule(spark):
    chunks = spark.createDataFrame([(1, 40), (2, 20)], "chunk int, n_rows long")
    rows = sorted(runlog.lr_schedule(chunks, 10, 2, 2, 0.25, 1.0).collect())
    # Two steps in the first chunk, one in the second, twice: six steps, one of warm-up.
    assert [tuple(r)[:4] for r in rows] == [(1, 1, 0, 1), (1, 2, 2, 2), (2, 1, 3, 4), (2, 2, 5, 5)]
    assert [x for r in rows for x in tuple(r)[4:]] == pytest.approx([0.0, 1.0, 0.8, 0.8, 0.6, 0.4, 0.2, 0.2])


def test_unmeasured_chunks_need_an_estimate(spark):
    chunks = spark.createDataFrame([(1, 100), (2, None)], "chunk int, n_rows long")
    with pytest.raises(Exception, match="need an estimate"):
        runlog.step_budget(chunks, 16, 2, 1, 0.1).collect()
    assert runlog.step_budget(chunks, 16, 2, 1, 0.1, estimate=100).first()["total_steps"] == 8


def test_epoch_rows_and_summary(spark):
    summary = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4)], "run_id string, epoch int, train_loss double")
    metrics = spark.createDataFrame([("a", 1, 0.7)], "run_id string, epoch int, macro_f1 double")
    log = runlog.epoch_rows(summary, metrics)
    assert sorted(tuple(r) for r in log.collect()) == [("a", 1, 0.5, 0.7), ("a", 2, 0.4, None)]
    plan = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "shard_id int, chunk int")
    shards = spark.createDataFrame([("train", 1), ("train", 0), ("val", 7)], "split string, shard_id int")
    test = spark.createDataFrame([("a", 0.6)], "run_id string, accuracy double")
    row = runlog.run_summary(log, plan, shards=shards, mode="lora", test_metrics=test).first()
    assert (row["best_epoch"], row["training_shards"], row["mode"], row["test_accuracy"]) == (1, 3, "lora", 0.6)
    assert (row["train_shards"], row["val_shards"], row["test_shards"]) == ([0, 1], [7], [])


def test_epoch_summary_counts_measured_rows(spark):
    rows = [(1, 1, 2.0, 16, 0.5), (1, 1, 4.0, 16, 0.5), (1, 1, 3.0, 7, 1.0), (1, 2, 1.0, 5, 0.0)]
    batches = spark.createDataFrame(rows, "epoch int, chunk int, loss double, n_rows int, seconds double")
    got = runlog.epoch_summary(batches, accumulate=2).first()
    assert (got["train_batches"], got["optimizer_steps"], got["items"]) == (4, 3, 44)
    assert (got["items_per_sec"], got["train_loss"]) == (22.0, 2.5)
