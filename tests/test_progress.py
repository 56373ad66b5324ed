"""What is kept from chunk to chunk: counters, shuffle buffers, and losses from blocks of logits."""

import math

import pytest
from pyspark.sql import functions as F

from tuneprep.operators import losses
from tuneprep.operators.logit_blocks import block_cross_entropy, block_parts, fold_blocks
from tuneprep.operators.metrics import classification_metrics, confusion
from tuneprep.streaming import progress
from tuneprep.streaming.buffer import ShuffleBuffer

INF = float("inf")


def predictions(spark, rows):
    return spark.createDataFrame(rows, "run string, index long, true_id int, predicted_id int, status string")


def test_figures_after_each_chunk_are_those_of_all_rows(spark, tmp_path):
    rows = [(("a", None)[i % 2], i, i % 4, (i * i) % 5 - 1, "unknown" if (i * i) % 5 == 0 else "valid_normalized") for i in range(60)]
    chunks = [rows[:20], rows[20:21], [], rows[21:60]]
    classes = spark.createDataFrame([(i,) for i in range(4)], "label_id int")
    path, seen = str(tmp_path / "counts"), []
    for n, chunk in enumerate(chunks):
        for _ in range(2):  # a chunk that is done again
            found = progress.running_accuracy_of_chunk(predictions(spark, chunk), path, n, ["run"], rows_per_bucket=7)
            found = found.collect()
        seen += found
        so_far = [r for c in chunks[: n + 1] for r in c]
        whole = predictions(spark, so_far)
        expected = classification_metrics(classes=classes, pairs=confusion(whole.select("true_id", F.col("predicted_id").alias("pred_id")))).first().asDict()
        assert progress.figures(spark, path, classes).first().asDict() == expected
        assert expected["unknown_rate"] == pytest.approx(sum(r[4] == "unknown" for r in so_far) / len(so_far))
    assert len(seen) == 60
    for r in seen:
        before = [x for x in rows if x[0] == r["run"] and x[1] <= r["index"]]
        assert r["n_seen"] == len(before) and r["n_correct"] == sum(x[2] == x[3] for x in before)
        assert r["unknown_so_far"] == sum(x[4] == "unknown" for x in before)
        assert r["running_accuracy"] == pytest.approx(r["n_correct"] / r["n_seen"])
    # As of an earlier chunk, although later ones were counted.
    assert progress.counters(spark, path, before=1).first()["n_seen"] == 20 and progress.counters(spark, path, before=0) is None


def test_a_buffer_gives_each_row_once_in_another_order(spark, tmp_path):
    def run(name, seed, limit=None, again=()):
        buffer = ShuffleBuffer(spark, str(tmp_path / name), ["id"], 10, seed, limit)
        for step in range(4):
            rows = spark.range(step * 20, step * 20 + 20)
            if step in again:
                buffer.push(spark.range(500, 530), step)
            if buffer.full():
                break
            buffer.push(rows, step)
            held = spark.read.parquet(f"{tmp_path}/{name}/held/step={step}")
            assert held.count() <= 10
        buffer.flush()
        buffer.flush()
        out = buffer.left().orderBy("position").collect()
        assert [r["position"] for r in out] == list(range(len(out)))
        return [r["id"] for r in out]

    one = run("one", 1)
    assert sorted(one) == list(range(80)) and one != list(range(80))
    assert one == run("same", 1, again=(1, 3)) and one != run("other", 2)
    # A row can leave in its own chunk or later, never before it is read.
    assert all(place >= (i // 20) * 20 - 10 for place, i in enumerate(one))
    assert run("limited", 1, 33) == one[:33] and run("less", 1, 500) == one
    empty = ShuffleBuffer(spark, str(tmp_path / "empty"), ["id"])
    empty.flush()
    assert empty.left() is None and not empty.full()
    empty.push(spark.range(0), 0)
    empty.flush()
    assert empty.left().count() == 0


def test_blocks_give_the_losses_of_whole_logits(spark):
    logits = [[1.0, 2.0, 3.0, 4.0, 5.0], [1000.0, -1000.0, 0.0, 999.0, 1.0], [-INF, -INF, 3.0, -INF, 2.0], [0.0] * 5, [INF, 0.0, 0.0, 0.0, 0.0]]
    rows = [(i, label, z) for i, z in enumerate(logits) for label in (0, 2, 4, -100, 5, -3, None)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "token int, row int, label int, logits array<double>")
    fault = losses.target_fault(F.col("logits"), F.col("label"))
    expected = {r["token"]: r for r in df.select("token", losses.cross_entropy(F.col("logits"), F.col("label")).alias("loss"), fault.alias("fault")).collect()}
    for width in (1, 2, 3, 5):
        blocks = df.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(4), F.lit(width)))).withColumn("logits", F.slice("logits", F.col("start") + 1, width))
        got = {r["token"]: r for r in block_cross_entropy(blocks, ["token"]).collect()}
        assert len(got) == len(expected)
        for k, r in expected.items():
            assert got[k]["fault"] == r["fault"]
            if r["fault"] is None:
                same = got[k]["loss"] == r["loss"] or (math.isnan(got[k]["loss"]) and math.isnan(r["loss"])) if r["loss"] is None or not math.isfinite(r["loss"]) else got[k]["loss"] == pytest.approx(r["loss"], abs=1e-9)
                assert same
    # A block that is missing, or there twice, is a fault, not a smaller sum.
    blocks = df.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("logits", F.slice("logits", F.col("start") + 1, 1)).where("token = 0")
    for broken in (blocks.where("start <> 2"), blocks.where("start > 0"), blocks.unionByName(blocks.where("start = 1")), blocks.where("start <> 4").unionByName(blocks.where("start = 0"))):
        assert block_cross_entropy(broken, ["token"]).first()["fault"] == "missing_block"


def test_no_logits_in_an_exchange(spark):
    blocks = spark.createDataFrame([(0, 1, 0, [1.0, 2.0])], "token int, label int, start int, logits array<float>")
    parts = block_parts(blocks, ["token"])
    assert "logits" not in parts.columns
    plan = fold_blocks(parts, ["token"])._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.split("\n") if "Exchange" in line)
    assert "logits" not in plan[: plan.index(exchange)] and plan.count("Exchange") >= 1


def test_next_labels_move_nothing(spark):
    df = spark.createDataFrame([(0, p, [0.5], [7, 8, -100]) for p in range(3)], "batch_id int, position long, logits array<float>, labels array<int>")
    pairs = losses.next_labels(df)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["position"], r["label"]) for r in pairs.collect()) == [(0, 8), (1, -100)]
