import random
import re

import pytest
from pyspark.sql import functions as F

from tuneprep.operators.bit_filter import WORD, bit_filter, bits_for, may_match
from tuneprep.operators.joins import lookup_join, salted_join
from tuneprep.operators.matching import match_predictions, match_table
from tuneprep.operators.vocab import VocabularyError
from tuneprep.plans.evaluate import score_answers, score_table


def vocab_table(spark, labels):
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, label_id int")


def matched(spark, answers, labels, **options):
    df = spark.createDataFrame(list(enumerate(answers)), "k int, raw_output string")
    found = match_predictions(df, vocab_table(spark, labels), row_key=["k"], **options)
    return [
        (r["predicted_label"], r["predicted_id"], r["status"])
        for r in sorted(found.collect(), key=lambda r: r["k"])
    ]


UNKNOWN = ("Unknown", -1, "unknown")
BOTH_WAYS = pytest.mark.parametrize("max_rows", [1000, 0], ids=["broadcast", "shuffle"])


@BOTH_WAYS
def test_first_label_in_vocabulary_order_wins(spark, max_rows):
    answers = ["severe leaf rust", "leaf rust", "rusty", None, " ", "Rust!"]
    hit = "valid_normalized"
    assert matched(spark, answers, ["rust", "leaf_rust"], max_rows=max_rows) == [
        ("rust", 0, hit), ("leaf_rust", 1, hit), UNKNOWN, UNKNOWN, UNKNOWN, ("rust", 0, hit),
    ]
    assert matched(spark, answers[:1], ["leaf_rust", "rust"], max_rows=max_rows) == [
        ("leaf_rust", 0, hit)
    ]
    assert matched(spark, answers[:1], ["rust", "leaf_rust"], longest=True, max_rows=max_rows) == [
        ("leaf_rust", 1, hit)
    ]
    assert matched(spark, answers[:1], ["rust"], containment=False, max_rows=max_rows) == [UNKNOWN]


@BOTH_WAYS
def test_equals_brute_force(spark, max_rows):
    rng = random.Random(2)
    words = ["a", "b", "c", "aa", "ab"]
    labels = sorted({"_".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(40)})
    rng.shuffle(labels)
    answers = ["_".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(2000)]

    def expected(p):
        if p in labels:
            return p
        parts = (x for x in labels if p.startswith(x + "_") or p.endswith("_" + x))
        return next(parts, "Unknown")

    found = matched(spark, answers, labels, max_rows=max_rows)
    assert [f[0] for f in found] == [expected(p) for p in answers]


@BOTH_WAYS
def test_labels_longer_than_the_lookup_chain(spark, max_rows):
    long_label = "_".join(f"w{i}" for i in range(20))
    found = matched(spark, ["x " + long_label.replace("_", " "), "x"], [long_label], max_rows=max_rows)
    assert [f[1] for f in found] == [0, -1]


@pytest.mark.parametrize("labels", [["Leaf Rust", "leaf-rust"], ["rust", "?!"]])
def test_labels_that_cannot_be_told_apart(spark, labels):
    with pytest.raises(VocabularyError):
        matched(spark, ["x"], labels)


def test_salted_join_with_a_hot_key(spark):
    """One key holds most rows; some keys are null, some are not in the table."""
    rows = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 != 0, F.lit("hot"))
        .when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"),
    )
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "key string, value int")
    for how in ("left", "inner"):
        plain = sorted(rows.join(table, "key", how).select("id", "value").collect())
        salted = salted_join(rows, table, "key", how, ["id"])
        assert sorted(salted.select("id", "value").collect()) == plain
        beyond = lookup_join(rows, table, "key", how, ["id"], max_rows=0)
        assert sorted(beyond.select("id", "value").collect()) == plain
    spread = salted_join(rows, table, "key", "left", ["id"])
    assert spread.columns == ["key", "id", "value"]


@BOTH_WAYS
def test_one_label_with_two_ids_is_an_error_on_both_paths(spark, max_rows):
    vocab = spark.createDataFrame([("rust", 0), ("rust", 1), ("blight", 2)], "label string, label_id int")
    answers = spark.createDataFrame([(1, "rust"), (2, "blight")], "k int, raw_output string")
    with pytest.raises(VocabularyError):
        match_predictions(answers, vocab, row_key=["k"], max_rows=max_rows)
    truth = answers.withColumn("true_label", F.col("raw_output"))
    with pytest.raises(VocabularyError):
        score_answers(truth, vocab, ["k"])
    with pytest.raises(VocabularyError):
        score_table(truth, vocab)


def test_long_labels_are_matched_by_a_broadcast_join_on_pieces(spark):
    labels = ["a_b_c_d_e_f", "x_y"]
    answers = ["a b c d e f on the leaf", "see x y", "a b c", "x y"]
    assert [m[0] for m in matched(spark, answers, labels)] == [
        "a_b_c_d_e_f", "x_y", "Unknown", "x_y",
    ]


def test_no_text_exchange_within_the_broadcast_bound(spark):
    answers = spark.range(50).select("id", F.concat(F.lit("leaf rust "), F.col("id")).alias("raw_output"))
    table = match_table(vocab_table(spark, ["rust", "spot"]))
    plan = match_predictions(answers, table, row_key=["id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning", plan)


def test_salts_follow_the_share_and_nulls_are_spread(spark):
    """Half of the rows have one key and a third none: neither fills a task."""
    rows = spark.range(12000).select(
        "id", F.when(F.col("id") % 6 < 3, F.lit("hot")).when(F.col("id") % 6 == 3, F.col("id").cast("string")).alias("key")
    )
    table = spark.createDataFrame([("hot", 1), ("3", 2)], "key string, value int")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(rows, table, "key", "left", ["id"])
        counts = joined.groupBy(F.spark_partition_id()).count().collect()
        assert joined.where("value = 1").count() == 6000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert max(r["count"] for r in counts) < 2 * 12000 / len(counts) and len(counts) == 4


def test_bit_filter_loses_no_key_and_stops_most_others(spark):
    table = spark.range(5000).select(F.concat(F.lit("label "), "id").alias("norm"))
    rows = spark.range(20000).select("id", F.concat(F.lit("label "), "id").alias("norm"))
    passed = rows.where(may_match(F.col("norm"), bit_filter(table, "norm", 5000)))
    ids = {r["id"] for r in passed.collect()}
    assert ids >= set(range(5000))
    assert len(ids) - 5000 < 0.03 * 15000


@pytest.mark.parametrize("keys, most", [(0, 1 << 20), (5000, WORD), (5000, 1 << 10)])
def test_bit_filter_that_is_too_small_loses_no_key(spark, keys, most):
    table = spark.range(5000).select(F.col("id").cast("string").alias("norm"))
    passed = table.where(may_match(F.col("norm"), bit_filter(table, "norm", keys, most)))
    assert passed.count() == 5000


def test_bit_filter_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",)], "norm string")
    assert rows.where(may_match(F.col("norm"), bit_filter(rows.limit(0), "norm", 0))).count() == 0
    nulls = rows.where("norm is null")
    assert rows.where(may_match(F.col("norm"), bit_filter(nulls, "norm", 1))).count() == 0
    found = rows.where(may_match(F.col("norm"), bit_filter(rows, "norm", 3))).collect()
    assert sorted(r["norm"] for r in found) == ["", "a"]


def test_bit_filter_has_a_bound():
    assert [bits_for(n) for n in (0, 4, 5, 1000)] == [64, 64, 128, 16384]
    assert bits_for(10**12) == 1 << 26


def test_large_vocabularies_shuffle_only_pieces_that_may_match(spark, monkeypatch):
    """The pieces that the join counts and shuffles, with the filter and without."""
    from tuneprep.operators import matching

    sent = []

    def counted(rows, table, on, *args, **options):
        if on == "norm":
            sent.append(rows.count())
        return salted_join(rows, table, on, *args, **options)

    monkeypatch.setattr(matching, "salted_join", counted)
    answers = [f"it is kind {i} of leaf spot {i % 7}" for i in range(500)]
    labels = [f"spot_{i}" for i in range(5)]
    with_filter = matched(spark, answers, labels, max_rows=0)
    monkeypatch.setattr(matching, "may_match", lambda key, found: F.lit(True))
    assert matched(spark, answers, labels, max_rows=0) == with_filter
    # Of five pieces of each answer at most the last word is a label: five of seven are.
    assert sent[1] == 2500
    assert 357 <= sent[0] <= 375
    assert [x[0] for x in with_filter[:3]] == ["spot_0", "spot_1", "spot_2"]
