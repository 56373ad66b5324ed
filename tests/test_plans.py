"""The physical plans are the ones we want."""

import re

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from tuneprep.operators import matching, metrics, ordering, splits, vocab
from tuneprep.session import materialise, shared_folder


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_has_no_shuffle_and_no_nested_loop(spark, folder):
    answers = fx.answers(spark, folder)
    plan = plan_of(matching.match_predictions(answers, fx.vocab(spark, folder), row_key=["k"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan


def test_large_vocabulary_has_no_nested_loop(spark, folder):
    answers = fx.answers(spark, folder)
    found = matching.match_predictions(answers, fx.vocab(spark, folder), row_key=["k"], max_rows=0)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_exact_split_does_not_move_rows(spark, folder):
    orders = fx.table(spark, folder, "orders")
    plan = plan_of(splits.fraction_split(orders, ["o_orderkey"]))
    main = plan.split("Subquery")[0] + plan.rsplit("+- FileScan", 1)[1]
    assert "Exchange" not in main
    inner = plan[plan.index("Subquery") :].rsplit("+- FileScan", 1)[0]
    for schema in re.findall(r"ReadSchema: (\S+)", inner):
        assert schema.startswith("struct<o_orderkey:bigint>")


def test_rank_is_single_only_above_the_bucket_counts(spark, folder):
    orders = fx.table(spark, folder, "orders").withColumn("h", ordering.seeded_hash(1, "o_orderkey"))
    lines = plan_of(ordering.hash_rank(orders, "h")).splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1 and "HashAggregate" in lines[single[0] + 1]


def test_label_scan_reads_the_label_only(spark, folder):
    plan = plan_of(vocab.distinct_labels(fx.table(spark, folder, "part"), "p_name"))
    assert "ReadSchema: struct<p_name:string>" in plan
    assert "PushedFilters: [IsNotNull(p_name)]" in plan
    assert plan.count("Exchange") == 1


def test_metrics_shuffle_pair_counts(spark, folder):
    plan = plan_of(metrics.confusion(fx.class_pairs(spark, folder)))
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_figures_have_no_nested_loop(spark, folder):
    pairs = metrics.confusion(fx.class_pairs(spark, folder))
    plan = plan_of(metrics.classification_metrics(pairs, fx.class_ids(spark, folder)))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_values_use_one_shuffle_of_the_rows(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = fx.table(spark, folder, "orders")
        out = ordering.running(
            orders, ["o_orderpriority"], "o_orderkey", {"total": ("sum", F.col("o_totalprice"))}
        )
        left = plan_of(out).split("Window", 1)[1].split("HashAggregate", 1)[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left.split("FileScan")[0].count("Exchange") == 1


def test_tables_are_kept_in_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")
    kept = materialise(spark.range(3), "kept")
    assert all(f.startswith(("file:" + shared_folder(spark), shared_folder(spark))) or
               shared_folder(spark) in f for f in kept.inputFiles())


@pytest.mark.parametrize("forbidden", ["localCheckpoint", "crossJoin", ".rdd", "toPandas", "F.udf"])
def test_the_library_avoids(forbidden):
    import pathlib

    root = pathlib.Path(vocab.__file__).parents[1]
    assert [p.name for p in root.rglob("*.py") if forbidden in p.read_text()] == []
