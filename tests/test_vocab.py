import pytest
from pyspark.sql import functions as F

from tuneprep.operators import vocab as v
from tuneprep.sources import vocab_store


def rows(spark, labels, name="disease"):
    return spark.createDataFrame([(x,) for x in labels], f"{name} string")


def table(spark, entries):
    return spark.createDataFrame(entries, "label string, label_id int")


def as_dict(frame):
    return {r["label"]: r["label_id"] for r in frame.collect()}


def test_labels_equal_after_strip_are_one(spark):
    made = v.build_vocab(rows(spark, ["b", " b", "a\xa0", None, "  ", "B"]))
    assert as_dict(made) == {"B": 0, "a": 1, "b": 2}


def test_extend_keeps_ids(spark):
    base = table(spark, [("z", 0), ("m", 1)])
    grown = v.extend_vocab(base, rows(spark, ["a", " z ", "c", "", None]))
    assert as_dict(grown) == {"z": 0, "m": 1, "a": 2, "c": 3}


def test_extend_from_nothing(spark):
    assert as_dict(v.extend_vocab(table(spark, []), rows(spark, ["q", "p"]))) == {"p": 0, "q": 1}


def test_extend_by_raw_order(spark):
    grown = v.extend_vocab(table(spark, [("k", 4)]), rows(spark, ["b", " c", "a"]), order_by="raw")
    assert as_dict(grown) == {"k": 4, "c": 5, "a": 6, "b": 7}


def test_chunk_by_chunk_equals_one_pass(spark):
    chunks = [["d", "b"], ["c", "a", "b"], ["e", "a"], ["0"]]
    data = spark.createDataFrame(
        [(i, x) for i, c in enumerate(chunks) for x in c], "chunk int, disease string"
    )
    grown = v.build_vocab(data.where("chunk = 0"))
    for i in range(1, 4):
        before = as_dict(grown)
        grown = v.extend_vocab(grown, data.where(F.col("chunk") == i))
        assert before.items() <= as_dict(grown).items()
    assert as_dict(grown) == as_dict(v.vocab_over_chunks(data, "chunk"))
    base = v.build_vocab(data.where("chunk = 0"))
    rest = v.vocab_over_chunks(data.where("chunk > 0"), "chunk", vocab=base)
    assert as_dict(rest) == as_dict(grown)


@pytest.mark.parametrize(
    "entries, rule",
    [
        ([], "empty_vocabulary"),
        ([("a", 0), (" ", 1)], "empty_label"),
        ([("a", 0), ("b", -1)], "negative_id"),
        ([("a", 0), ("a", 1)], "two_ids"),
        ([("a", 0), ("b", 0)], "shared_id"),
        ([("a", 0), ("b", 2)], "not_contiguous"),
        ([("a", 1), ("b", 2)], "not_contiguous"),
    ],
)
def test_faults(spark, entries, rule):
    faulty = table(spark, entries)
    assert rule in {r["rule"] for r in v.violations(faulty).collect()}
    with pytest.raises(v.VocabularyError, match=rule):
        v.require_valid(faulty)


def test_intact_vocabulary(spark):
    good = table(spark, [("b", 1), ("a", 0)])
    assert v.violations(good).collect() == []
    assert v.require_valid(good) is good


def test_preflight(spark):
    known = table(spark, [("a", 0)])
    assert v.require_labels(known, rows(spark, ["a", " a", None])) == 1
    with pytest.raises(v.VocabularyError, match="2 of 3.*'b', 'c'"):
        v.require_labels(known, rows(spark, ["a", "c", "b"]))


def test_store(spark, tmp_path):
    path = str(tmp_path / "vocab")
    assert vocab_store.load_vocab(spark, path) is None
    made = vocab_store.load_or_create_vocab(rows(spark, ["b", "a"]), path)
    again = vocab_store.load_or_create_vocab(rows(spark, ["z"]), path)
    assert as_dict(made) == as_dict(again) == {"a": 0, "b": 1}
    vocab_store.save_vocab(table(spark, [("a", 0), ("b", 1), ("c", 2)]), path, 3)
    assert vocab_store.versions(spark, path) == [0, 3]
    assert len(as_dict(vocab_store.load_vocab(spark, path))) == 3
    assert len(as_dict(vocab_store.load_vocab(spark, path, before=3))) == 2
    assert vocab_store.load_vocab(spark, path, version=1) is None
    with pytest.raises(v.VocabularyError):
        vocab_store.save_vocab(table(spark, [("a", 1)]), path, 4)
    # A version without its success mark was not written to the end.
    spark.range(1).write.parquet(f"{path}/version=9")
    (tmp_path / "vocab" / "version=9" / "_SUCCESS").unlink()
    assert vocab_store.versions(spark, path) == [0, 3]


def test_json(spark, tmp_path):
    path = str(tmp_path / "labels.json")
    vocab_store.write_vocab_json(table(spark, [('a "q"', 1), ("é\n", 0)]).na.drop(), path)
    assert as_dict(vocab_store.read_vocab_json(spark, path)) == {'a "q"': 1, "é\n": 0}
    plain = tmp_path / "plain.json"
    plain.write_text('{\n "label2id": {"x": 0, "y": 1}, "id2label": {"0": "x", "1": "y"}\n}')
    assert as_dict(vocab_store.read_vocab_json(spark, str(plain))) == {"x": 0, "y": 1}
    plain.write_text('{"labels": {}}')
    with pytest.raises(v.VocabularyError, match="label2id"):
        vocab_store.read_vocab_json(spark, str(plain))


def test_numbers_are_given_in_ranges(spark):
    """No task sees all labels, and the ids are those of one ordered list."""
    many = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("disease"))
    made = v.build_vocab(many)
    assert [r["label"] for r in sorted(made.collect(), key=lambda r: r["label_id"])] == sorted(r["disease"] for r in many.collect())
    plan = made._jdf.queryExecution().executedPlan().toString()
    labels = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert all("label" not in line for line in labels)


def test_of_two_creators_one_wins_and_the_other_reads_its_ids(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vocab")
    rows = [spark.createDataFrame([(x,) for x in labels], "disease string") for labels in ("ba", "dcb")]
    load, first = vocab_store.load_vocab, []

    def late(*args, **options):
        """Nothing is there when the second creator looks; then the first one publishes."""
        if not first:
            first.append(vocab_store.create_vocab(vocab_store.build_vocab(rows[0]), path))
            return None
        return load(*args, **options)

    monkeypatch.setattr(vocab_store, "load_vocab", late)
    assert as_dict(vocab_store.load_or_create_vocab(rows[1], path)) == {"a": 0, "b": 1} and first == [True]
    # An extension of a version that has been extended already is not published.
    assert vocab_store.create_vocab(table(spark, [("a", 0), ("b", 1), ("c", 2)]), path, 1)
    assert not vocab_store.create_vocab(table(spark, [("a", 0), ("b", 1), ("x", 2)]), path, 1)
    assert as_dict(load(spark, path)) == {"a": 0, "b": 1, "c": 2} and vocab_store.versions(spark, path) == [0, 1]
    assert sorted(p.name for p in (tmp_path / "vocab").iterdir()) == ["version=0", "version=1"]
