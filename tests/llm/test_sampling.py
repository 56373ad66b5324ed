"""Bounded samples: the same rows whatever the plan, and no exchange of all rows by label."""

from pyspark.sql import functions as F

from tuneprep.llm import sampling as S


def test_rows_of_a_frequent_label_are_filtered_before_any_exchange(spark, monkeypatch):
    rows = spark.range(50_000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("often").alias("label"))
    rows = S.materialise(rows, "rows")
    plans, real = [], S.materialise

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(S, "materialise", seen)
    usual = S.sample(rows, "label", "id", 40).collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert sorted(S.sample(rows, "label", "id", 40).collect()) == sorted(usual)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    drawn = [plan for name, plan in plans if name == "sample"]
    assert len(drawn) == 2
    for plan in drawn:
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        # The task that ranks a label gets what each task left of it, not all its rows.
        assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    counts = {x: sum(r["label"] == x for r in usual) for x in ("rare", "often")}
    assert counts == {"rare": 40, "often": 40}


def test_texts_for_the_driver_are_bounded_in_rows_and_bytes(spark):
    rows = [(1, "a", "x" * 10)] * 500 + [(i, "b", "y" * 100) for i in range(50)] + [(60, "c", "z" * 5000), (61, "c", None), (62, "c", "")]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    kept = S.within_bytes(df, "label", "id", 40, longest=1000, in_all=2000).collect()
    counts = {x: sum(r["label"] == x for r in kept) for x in "abc"}
    # One id that repeats gives 40 rows, 2,000 bytes are 20 texts of 100, and a long text does not displace others.
    assert counts == {"a": 40, "b": 20, "c": 1}
    assert S.within_bytes(df.limit(0), "label", "id", 40).count() == 0


def test_a_repeated_id_and_long_texts_do_not_reach_the_driver(spark, monkeypatch):
    from tuneprep.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, *_: seen.extend(texts) or toxicity.Model(*(toxicity.np.zeros(s) for s in ((2, 1), (1, 2), 2))))
    documents = [(1, "bad words")] * 300 + [(2, "good words"), (3, "x" * (S.LONGEST + 1)), (4, None)]
    labels = [(1, 1), (2, 0), (3, 0), (4, 0)]
    toxicity.fit(spark.createDataFrame(documents, "id long, text string"), spark.createDataFrame(labels, "id long, label int"), per_label=50)
    assert sorted(set(seen)) == ["bad words", "good words"]
    assert len(seen) == 51
