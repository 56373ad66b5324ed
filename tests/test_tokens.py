import math

import pytest
from pyspark.sql import functions as F

from tuneprep.functions import chat, tokens
from tuneprep.operators import batches, losses
from tuneprep.plans import prepare


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else
                                  F.array(*[F.lit(x) for x in v]).cast("array<int>").alias(k)
                                  for k, v in values.items()])
    return row.select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "n, text, prompt, expected", [(10, 8, 3, 5), (10, 12, 3, 3), (4, 4, 9, 4), (0, 0, 0, 0)]
)
def test_boundary(spark, n, text, prompt, expected):
    got = one(spark, tokens.boundary(F.col("n"), F.col("t"), F.col("p")), n=n, t=text, p=prompt)
    assert got == expected


def test_mask_and_targets(spark):
    ids = [5, 6, 7, 8]
    for prompt, labels in [(0, ids), (3, [-100] * 3 + [8]), (4, [-100] * 4), (9, [-100] * 4)]:
        made = one(spark, tokens.mask_prompt(F.col("ids"), F.col("p")), ids=ids, p=prompt)
        assert made == labels
        fault = one(spark, tokens.target_fault(tokens.mask_prompt(F.col("ids"), F.col("p"))), ids=ids, p=prompt)
        assert fault == ("no_target" if prompt >= 4 else None)


def test_pad_slice_shift(spark):
    pad = one(spark, tokens.left_pad(F.col("ids"), F.col("n"), 9), ids=[1, 2], n=4)
    assert pad == [9, 9, 1, 2]
    assert one(spark, tokens.left_pad(F.col("ids"), F.col("n"), 9), ids=[1, 2], n=1) == [1, 2]
    assert one(spark, tokens.completion(F.col("ids"), F.col("n")), ids=[1, 2, 3], n=2) == [3]
    assert one(spark, tokens.completion(F.col("ids"), F.col("n")), ids=[1, 2, 3], n=5) == []
    pairs = one(spark, tokens.shift_pairs(F.col("a"), F.col("b")), a=[1, 2, 3], b=[7, 8, 9])
    assert [(p["value"], p["label"]) for p in pairs] == [(1, 8), (2, 9)]
    assert one(spark, tokens.shift_pairs(F.col("a"), F.col("b")), a=[1], b=[7]) == []


def test_words(spark):
    assert one(spark, tokens.split_words(F.col("t")), t=" a　b\n c ") == ["a", "b", "c"]
    assert one(spark, tokens.word_ids(F.col("t")), t=" \n") == []


def test_answer_is_not_in_the_prompt(spark):
    df = spark.createDataFrame(
        [(1, "tomato", "leaf rust", 0), (2, "", "tar spot", 1)],
        "sample_id int, crop string, disease string, label_id int",
    )
    asked = prepare.generation_rows(df).collect()
    assert [r["disease"] in r["prompt_text"] for r in asked] == [False, False]
    assert "Given this tomato crop image" in asked[0]["prompt_text"]
    assert "Given this crop image" in asked[1]["prompt_text"]
    assert asked[0]["prompt_text"].endswith("<|im_start|>assistant\n")
    assert "labels" not in prepare.generation_rows(df).columns
    made = {r["sample_id"]: r for r in prepare.training_rows(df, image_tokens=F.lit(3), image_id=7).collect()}
    row = made[1]
    assert row["input_ids"][:3] == [7, 7, 7]
    assert row["boundary"] == row["prompt_length"] + 3 or row["reason"] is None
    assert len(row["labels"]) == len(row["input_ids"]) == len(row["attention_mask"])
    kept = [x for x in row["labels"] if x != -100]
    assert kept and row["input_ids"][-len(kept):] == kept


def test_template_is_a_parameter(spark):
    plain = chat.ChatTemplate(start="[", end="]", role_end=":", image="<img>", open_role="model")
    text = spark.range(1).select(
        chat.render(chat.conversation(F.lit("corn"), F.lit("rust")), plain).alias("full"),
        chat.render(chat.conversation(F.lit("corn")), plain, open_turn=True).alias("ask"),
    ).first()
    assert text["full"].endswith("][assistant:rust]")
    assert text["ask"].endswith("][model:") and "<img>Given this corn crop image" in text["ask"]


def example(k, batch, ids, labels, reason=None):
    return (k, batch, ids, [1] * len(ids), labels, reason)


SCHEMA = "k int, batch_id int, input_ids array<int>, attention_mask array<int>, labels array<int>, reason string"


def test_collate(spark):
    df = spark.createDataFrame(
        [
            example(1, 0, [1, 2, 3], [-100, 2, 3]),
            example(2, 0, [4], [4]),
            example(3, 0, [5] * 9, [5] * 9, "no_target"),
            example(4, 1, [6, 7], None),
            example(5, 1, [8], [8]),
            example(6, 2, [9], [9], "no_target"),
        ],
        SCHEMA,
    )
    rows = {r["k"]: r for r in batches.collate(df, pad_id=77).collect()}
    assert sorted(rows) == [1, 2, 4, 5]
    assert rows[2]["input_ids"] == [77, 77, 4]
    assert rows[2]["attention_mask"] == [0, 0, 1]
    assert rows[2]["labels"] == [-100, -100, 4]
    assert rows[1]["padding"] == 0 and rows[2]["padding"] == 2
    assert rows[4]["labels"] is None and rows[5]["labels"] is None
    assert rows[5]["input_ids"] == [77, 8]
    assert [r["batch_id"] for r in batches.empty_batches(df).collect()] == [2]
    with pytest.raises(batches.EmptyBatchError, match="2"):
        batches.require_batches(df)
    without = batches.collate(df.drop("labels"), pad_id=0)
    assert "labels" not in without.columns


def test_cross_entropy(spark):
    rows = [
        (0, 0, [1.0, 2.0, 3.0], -100),
        (0, 1, [1000.0, 0.0, -1000.0], 2),
        (0, 2, [0.0, 0.0, 0.0], 0),
        (1, 0, [0.0, 0.0, 0.0], 1),
        (1, 1, [9.0, 9.0, 9.0], -100),
    ]
    df = spark.createDataFrame(rows, "batch_id int, position long, logits array<float>, label int")
    pairs = losses.causal_pairs(df, ["batch_id"])
    priced = pairs.withColumn("loss", losses.cross_entropy(F.col("logits"), F.col("label")))
    got = {(r["batch_id"], r["position"]): r["loss"] for r in priced.collect()}
    first = math.log(sum(math.exp(x) for x in (1, 2, 3))) - 3
    assert got[(0, 0)] == pytest.approx(first)
    assert got[(0, 1)] == pytest.approx(0.0)
    assert got[(1, 0)] is None
    per_batch = losses.batch_losses(priced)
    with pytest.raises(losses.LossError, match="no_target"):
        losses.require_losses(per_batch)
    good = losses.require_losses(per_batch.where("batch_id = 0"))
    summary = losses.loss_summary(good).first()
    assert summary["val_loss"] == pytest.approx(first / 2)
    assert summary["valid_target_tokens"] == 2
    wild = spark.createDataFrame([(0, float("inf")), (1, float("nan"))], "batch_id int, loss double")
    assert {r["fault"] for r in losses.batch_losses(wild).collect()} == {"not_finite"}


def test_mean_of_batch_means_is_not_the_token_mean(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (0, 1.0), (1, 3.0)], "batch_id int, loss double")
    summary = losses.loss_summary(losses.batch_losses(df)).first()
    assert (summary["val_loss"], summary["token_loss"]) == (2.0, 1.5)
