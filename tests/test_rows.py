import pandas as pd
import pytest
from pyspark.sql import functions as F

from tuneprep.functions import pixels, tokens
from tuneprep.operators import batches, inference, losses, splits, validation
from tuneprep.plans import prepare
from tuneprep.plans.evaluate import evaluate, score_table
from tuneprep.sources import images, shards, sinks

VOCAB = [("rust", 0), ("spot", 1)]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(VOCAB, "label string, label_id int")


def samples(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "sample_id int, disease string, crop string, label_id string"
    )


CASES = [
    ((" rust\xa0", " corn ", None), ("rust", "corn", 0, "vocabulary", None)),
    (("spot", None, " 1 "), ("spot", "", 1, "checked", None)),
    (("mould", "x", "7"), ("mould", "x", 7, "given", None)),
    ((None, "x", "0"), (None, "x", None, None, "missing_label")),
    ((" \t", "x", None), ("", "x", None, None, "empty_label")),
    (("rust", "x", "1"), ("rust", "x", None, None, "id_mismatch")),
    (("rust", "x", "-1"), ("rust", "x", None, None, "negative_id")),
    (("rust", "x", "one"), ("rust", "x", None, None, "bad_id")),
    (("rust", "x", "1.5"), ("rust", "x", None, None, "bad_id")),
    (("mould", "x", None), ("mould", "x", None, None, "unknown_label")),
]


def test_reasons(spark, vocab):
    checked = validation.resolve_labels(samples(spark, [c[0] for c in CASES]), vocab)
    rows = sorted(checked.collect())
    assert [tuple(r)[1:] for r in rows] == [c[1] for c in CASES]
    assert validation.good_rows(checked).count() == 3
    assert validation.quarantine(checked).count() == 7
    with pytest.raises(validation.BadRowsError, match="'bad_id': 2"):
        validation.require_good(checked)
    good = validation.resolve_labels(samples(spark, [CASES[0][0]]), vocab)
    assert validation.require_good(good).count() == 1


def test_crop_column_may_be_absent(spark, vocab):
    checked = validation.resolve_labels(samples(spark, [CASES[0][0]]).drop("crop"), vocab)
    assert checked.first()["crop"] == ""


def parrot():
    def answer(batch):
        return [f"The disease is {p}. " for p in batch["payload"]]

    return answer


def test_predict_batches_and_loads_once_per_task(spark):
    def make():
        loaded = []

        def answer(batch):
            loaded.append(len(batch))
            return [f" {len(batch)} {len(loaded)} a b c" for _ in range(len(batch))]

        return answer

    df = spark.range(10).coalesce(1)
    out = inference.predict(df, make, ["id"], batch_size=4).collect()
    assert sorted(r["raw_output"] for r in out) == ["2 3 a b c"] * 2 + ["4 1 a b c"] * 4 + ["4 2 a b c"] * 4


def test_evaluate(spark, vocab):
    rows = samples(spark, [("rust", "c", None), ("spot", "c", None), ("rust", "c", None), (None, "c", None)])
    rows = rows.withColumn("payload", F.element_at(F.array(*[F.lit(x) for x in ("rust", "rust leaf", "?", "x")]), F.col("sample_id") + 1))
    with pytest.raises(validation.BadRowsError):
        evaluate(rows, vocab, lambda: parrot(), ["payload"])
    with pytest.raises(ValueError, match="must not see"):
        evaluate(rows, vocab, lambda: parrot(), ["disease"])

    def make():
        return lambda batch: [f"The disease is {p}. " for p in batch["payload"]]

    result = evaluate(rows, vocab, make, ["payload"], strict=False)
    got = {r["sample_id"]: (r["predicted_label"], r["correct"]) for r in result.predictions.collect()}
    assert got == {0: ("rust", True), 1: ("rust", False), 2: ("Unknown", False)}
    figures = result.metrics.first()
    assert figures["accuracy"] == pytest.approx(1 / 3)
    assert figures["unknown_predictions"] == 1
    # The bad row comes after the first ones, and is not looked at; then it is among them.
    first = evaluate(rows, vocab, make, ["payload"], max_samples=2)
    assert sorted(r["sample_id"] for r in first.predictions.collect()) == [0, 1]
    backwards = rows.withColumn("index", F.lit(3).cast("bigint") - F.col("sample_id"))
    with pytest.raises(validation.BadRowsError):
        evaluate(backwards, vocab, make, ["payload"], max_samples=2, index="index")
    last = evaluate(backwards, vocab, make, ["payload"], max_samples=2, index="index", strict=False)
    assert [(r["sample_id"], r["index"]) for r in last.predictions.collect()] == [(2, 1)]


def test_the_model_may_see_the_prompt(spark, vocab):
    rows = samples(spark, [("rust", "corn", None), ("spot", None, None)])

    def make():
        return lambda batch: ["rust" if "corn" in p else "spot" for p in batch["prompt_text"]]

    assert evaluate(rows, vocab, make, ["prompt_text"]).metrics.first()["accuracy"] == 1.0


def test_score_table_weighs_equal_answers(spark, vocab):
    rows = [("rust", "Rust!")] * 50 + [("spot", "rust")] * 7 + [("spot", None)] * 3
    answers = spark.createDataFrame(rows, "true_label string, raw_output string")
    got = score_table(answers, vocab).first()
    assert got["num_samples"] == 60
    assert got["accuracy"] == pytest.approx(50 / 60)
    assert got["unknown_predictions"] == 3


def test_scan(spark, tmp_path):
    folder = tmp_path / "data"
    with pytest.raises(FileNotFoundError):
        shards.scan_shards(spark, str(folder))
    spark.range(3).coalesce(1).write.parquet(str(folder))
    spark.range(5, 9).withColumn("extra", F.lit("x")).coalesce(1).write.mode("append").parquet(str(folder))
    (folder / "note.txt").write_text("not parquet")
    (folder / "half.parquet.tmp").write_text("not parquet")
    df = shards.with_index(shards.scan_shards(spark, str(folder)), shards.file_rows(spark, str(folder)))
    rows = df.collect()
    assert sorted(r["index"] for r in rows) == list(range(7))
    assert {r["id"]: r["extra"] for r in rows} == {0: None, 1: None, 2: None, **{i: "x" for i in range(5, 9)}}
    by_file = sorted((r["shard_file"], r["shard_row"], r["index"]) for r in rows)
    assert [r[2] for r in by_file] == list(range(7))
    given = shards.scan_shards(spark, str(folder), "id bigint")
    assert given.count() == 7 and "extra" not in given.columns


def test_columns(spark):
    df = spark.createDataFrame([(b"i", "d", 3)], "pic binary, ill string, n int")
    with pytest.raises(KeyError, match=r"\['disease', 'image'\]"):
        shards.check_columns(df, ["image", "disease"])
    mapped = shards.map_columns(df, "pic", "ill", "crop", "n")
    assert mapped.columns == ["image", "disease", "crop", "label_id"]
    assert tuple(mapped.first())[1:] == ("d", None, "3")
    assert shards.map_columns(df, "pic", "ill", "", "").first()["label_id"] is None


def test_audit(spark, tmp_path):
    for name, size in {
        "train-00000.parquet": 1001, "train-00001.parquet": 1000, "train-00002.parquet.tmp": 5000,
        "train-00004.parquet": 2000, "train-00004.parquet.tmp": 10, "train-00047.parquet": 3000, "other.parquet": 9999,
    }.items():
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r["shard_id"]: r["state"] for r in shards.shard_audit(spark, str(tmp_path), 48, range(5)).collect()}
    assert got == {0: "ok", 1: "too_small", 2: "unfinished", 3: "missing", 4: "ok", 47: "stale"}


def test_prediction_file(spark, tmp_path):
    texts = ['say "hi"', "two\nlines", "a,b", "", " spaced ", "back\\slash", "tab\t", "'q'", '"', "é\r\nx", None]
    df = spark.createDataFrame(
        [(i, "t", 0, "p", -1, "unknown", False, x) for i, x in enumerate(texts)], sinks.PREDICTION_SCHEMA
    )
    path = str(tmp_path / "predictions")
    sinks.write_predictions(df, path)
    got = {r["index"]: r["raw_model_output"] for r in sinks.read_predictions(spark, path).collect()}
    assert [got[i] for i in range(len(texts))] == ["" if x is None else x for x in texts]


def test_metrics_and_log_files(spark, tmp_path):
    path = str(tmp_path / "metrics")
    sinks.write_metrics(spark.createDataFrame([(0.5, None)], "accuracy double, loss double"), path)
    assert spark.read.text(path).first()["value"] == '{"accuracy":0.5,"loss":null}'
    path = str(tmp_path / "log")
    for epoch in (1, 2):
        sinks.append_run_log(spark.createDataFrame([("r", epoch, 0.1)], "run_id string, epoch int, loss double"), path)
    back = sinks.read_run_log(spark, path, "epoch int, loss double, run_id string")
    assert sorted(r["epoch"] for r in back.collect()) == [1, 2]
    # Other column order, an epoch that is run again, another run.
    again = spark.createDataFrame([(0.7, 2, "r"), (0.9, 1, "s")], "loss double, epoch int, run_id string")
    sinks.append_run_log(again, path)
    back = sinks.read_run_log(spark, path, "epoch int, loss double, run_id string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, 0.1, "r"), (1, 0.9, "s"), (2, 0.7, "r")]
    path = str(tmp_path / "named")
    sinks.write_metrics(spark.createDataFrame([(0.5,)], "accuracy double"), path, checkpoint="best", validation_shard=36)
    assert spark.read.text(path).first()["value"] == '{"accuracy":0.5,"checkpoint":"best","validation_shard":36}'


def test_an_id_beyond_32_bits_is_a_bad_row(spark, vocab):
    rows = samples(spark, [("other", "c", "9999999999"), ("rust", "c", "1.5"), ("rust", "c", "0")])
    got = {r["sample_id"]: r["reason"] for r in validation.resolve_labels(rows, vocab).collect()}
    assert got[0] == got[1] == "bad_id"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_change_no_index(spark, tmp_path):
    folder = str(tmp_path / "data")
    for part in ("a", "b", "c"):
        spark.range(3).coalesce(1).write.parquet(f"{folder}/part={part}")
    scan = shards.scan_shards(spark, folder)
    files = shards.file_rows(spark, folder)
    # Rows are counted without a column: only footers are read.
    assert "ReadSchema: struct<>" in _plan(files)
    for condition, expected in (("shard_row >= 1", [1, 2, 4, 5, 7, 8]), ("shard_row < 2", [0, 1, 3, 4, 6, 7]), ("part = 'b'", [3, 4, 5]), ("id = 9", [])):
        assert sorted(r["index"] for r in shards.with_index(scan.where(condition), files).collect()) == expected
    spark.range(4).coalesce(1).write.parquet(f"{folder}/part=d")
    with pytest.raises(Exception, match="have changed"):
        shards.with_index(shards.scan_shards(spark, folder), files).collect()
    with pytest.raises(splits.SplitError):
        splits.shard_split(F.lit(1), {"train": (0, 5), "val": (5, 7)})


def test_a_manifest_reads_only_new_footers(spark, tmp_path, monkeypatch):
    folder, path = str(tmp_path / "data"), str(tmp_path / "manifest")
    opened, count = [], shards.file_rows
    monkeypatch.setattr(shards, "file_rows", lambda s, f, paths: opened.append(len(paths)) or count(s, f, paths))

    def index():
        return [tuple(r) for r in shards.index_manifest(spark, folder, path).orderBy("shard_file").select("n_rows", "first_index").collect()]

    for part, rows in (("a", 3), ("b", 0), ("c", 2)):
        spark.range(rows).coalesce(1).write.parquet(f"{folder}/part={part}")
    assert index() == index() == [(3, 0), (0, 3), (2, 3)]
    spark.range(5).coalesce(1).write.parquet(f"{folder}/part=aa")
    assert index() == [(3, 0), (5, 3), (0, 8), (2, 8)]
    spark.range(4).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part=c")
    assert index() == [(3, 0), (5, 3), (0, 8), (4, 8)]
    assert opened == [3, 1, 1]
    scan = shards.scan_shards(spark, folder)
    assert sorted(r["index"] for r in shards.with_index(scan, shards.index_manifest(spark, folder, path)).collect()) == list(range(12))


def test_only_wanted_shards_are_listed_and_opened(spark, tmp_path):
    folder = str(tmp_path / "data")
    spark.range(48).selectExpr("id", "format_string('%05d', id) as shard").repartition(2, "shard").write.partitionBy("shard").parquet(folder)
    files = shards.shard_files(spark, folder, r"shard=(\d{5})/")
    assert files.count() == 48
    wanted = [r["path"] for r in files.where("shard_id between 36 and 41").collect()]
    rows = shards.read_shards(spark, folder, wanted, "id bigint")
    assert "InMemoryFileIndex(6 paths)" in _plan(rows)
    assert sorted((r["id"], r["shard_file"][:11], r["shard_row"]) for r in rows.collect()) == [(i, f"shard={i:05d}", 0) for i in range(36, 42)]
    with pytest.raises(FileNotFoundError):
        shards.read_shards(spark, folder, [], "id bigint")


def test_targets_outside_the_logits_are_faults(spark):
    rows = [(1, [0.0, 1.0], 7), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], -100), (3, [0.0, 1.0], None), (4, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "batch_id int, logits array<double>, label int").select(
        "batch_id",
        losses.cross_entropy(F.col("logits"), F.col("label")).alias("loss"),
        losses.target_fault(F.col("logits"), F.col("label")).alias("bad"),
    )
    got = {r["batch_id"]: tuple(r)[1:] for r in losses.batch_losses(df, fault="bad").collect()}
    assert got[1] == (None, 2, "bad_target") and got[3] == (None, 1, "bad_target")
    assert got[2] == (None, 0, "no_target") and got[4][1:] == (1, None)
    with pytest.raises(losses.LossError):
        losses.require_losses(losses.batch_losses(df, fault="bad"))


def test_no_example_vanishes(spark):
    rows = spark.createDataFrame([(i, "rust", "c", 0) for i in range(4)], "sample_id int, disease string, crop string, label_id int")
    cut = lambda text: F.slice(tokens.word_ids(text), 1, 2)
    with pytest.raises(prepare.NoTargetError):
        prepare.training_batches(rows, ["sample_id"], 2, 0, tokenise=cut)
    with pytest.raises(batches.EmptyBatchError):
        prepare.training_batches(rows, ["sample_id"], 2, 0, tokenise=cut, strict=False)
    made = prepare.training_batches(rows, ["sample_id"], 2, 0)
    whole = prepare.training_rows(rows).where("sample_id = 0").first()
    row = made.batches.where("sample_id = 0").first()
    assert made.quarantine.count() == 0 and made.batches.count() == 4
    assert (row["input_ids"], row["labels"], row["attention_mask"]) == (whole["input_ids"], whole["labels"], whole["attention_mask"])


def test_forms_of_images(spark):
    png = bytes.fromhex("89504E470D0A1A0A")
    cases = {
        "x binary": (png, "bytes"),
        "x struct<bytes:binary,path:string>": ((png, "p"), "bytes"),
        "x struct<path:string>": (("p",), "path"),
        "x struct<data:array<float>>": (([1.0],), "array"),
        "x struct<image:binary>": ((png,), "bytes"),
        "x array<array<int>>": ([[1]], "array"),
    }
    for schema, (value, kind) in cases.items():
        df = spark.createDataFrame([(value,), (None,)], schema)
        image = pixels.payload(df, "x")
        got = df.select(pixels.payload_kind(image).alias("k"), pixels.payload_fault(image).alias("f")).collect()
        assert [tuple(r) for r in got] == [(kind, None), (None, "no_image")], schema


def test_images_reach_the_model_in_batches_bounded_in_bytes(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * 100_000)
    rows = spark.range(0, 400, 1, 1).select("id", F.concat((F.col("id") % 40).cast("string"), F.lit(".bin")).alias("image"))
    rows = rows.repartition("id").withColumn("image", pixels.payload(rows, "image"))

    def make():
        def model(batch):
            assert len(batch) <= 4
            return [str(len(x)) for x in batch["image_bytes"]]

        return model

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    try:
        whole = images.with_bytes(rows, F.col("image"), str(tmp_path), ["id"])
        found = inference.predict(whole, make, ["image_bytes"], batch_size=4).select("id", "raw_output")
        assert {r["raw_output"] for r in found.collect()} == {"100000"}
        assert found.count() == 400

        @F.pandas_udf("long")
        def held(data: pd.Series) -> pd.Series:
            return pd.Series([data.map(len).sum()] * len(data), dtype="int64")

        # Spark ends a batch with the row that passes the bound.
        assert whole.agg(F.max(held("image_bytes"))).first()[0] <= (1 << 20) + 100_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
