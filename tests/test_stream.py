"""Rolling ingest over a plan: order, kills and restarts, one writer, what is written and read."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tuneprep.operators.vocab import VocabularyError, distinct_labels, vocab_over_chunks
from tuneprep.sources import commit_log, files, vocab_increments
from tuneprep.streaming import ingest
from tuneprep.streaming.plan_source import PlanReader

SCHEMA = "sample_id bigint, disease string"
SHARDS = [["d", "b"], ["c", " b"], ["a", None], ["e", ""], ["0", "d"], ["f", "a"], ["z", "z"]]


def write_shards(spark, folder, numbers, newest_first=False):
    os.makedirs(folder, exist_ok=True)
    for n in numbers:
        rows = [(n * 10 + i, x) for i, x in enumerate(SHARDS[n])]
        staged = f"{folder}-staged-{n}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(staged)
        part = next(f for f in os.listdir(staged) if f.endswith(".parquet"))
        target = os.path.join(folder, f"train-{n:05d}.parquet")
        with open(os.path.join(staged, part), "rb") as src, open(target, "wb") as dst:
            dst.write(src.read())
        age = -n if newest_first else n
        os.utime(target, (time.time() - 1000 + age * 10,) * 2)


def make_run(spark, tmp_path, **options):
    folder = str(tmp_path / "shards")
    return ingest.Run(spark, ingest.shard_plan(spark, folder, 2), folder, SCHEMA, str(tmp_path / "run"), **options)


def ids(vocab):
    return {r["label"]: r["label_id"] for r in vocab.collect()}


def expected(spark, shards=SHARDS):
    rows = [(n // 2, x) for n, labels in enumerate(shards) for x in labels]
    return ids(vocab_over_chunks(spark.createDataFrame(rows, "chunk int, disease string"), "chunk"))


@pytest.mark.parametrize("newest_first", [False, True])
def test_ids_follow_the_plan_and_not_file_times(spark, tmp_path, newest_first):
    write_shards(spark, str(tmp_path / "shards"), range(7), newest_first)
    seen = []
    run = make_run(spark, tmp_path, work=lambda rows, vocab, position: seen.append((position, sorted(r["sample_id"] for r in rows.collect()), vocab.count())))
    run.finish()
    assert ids(run.vocab()) == expected(spark)
    assert seen == [(0, [0, 1, 10, 11], 3), (1, [20, 21, 30, 31], 5), (2, [40, 41, 50, 51], 7), (3, [60, 61], 8)]
    log = [(r["entry"], r["epoch"], r["chunk"], r["total_chunks"], r["validated"], r["n_rows"], r["n_labels"], r["shards"]) for r in run.log().orderBy("entry").collect()]
    name = "train-{:05d}.parquet".format
    assert log == [
        (0, 1, 1, 4, False, 4, 3, [name(0), name(1)]),
        (1, 1, 2, 4, False, 4, 2, [name(2), name(3)]),
        (2, 1, 3, 4, False, 4, 4, [name(4), name(5)]),
        (3, 1, 4, 4, False, 2, 1, [name(6)]),
        (4, 1, 4, 4, True, None, None, None),
    ]
    # Nothing is left to do, and nothing is done.
    assert run.start() is None and len(seen) == 4


def test_kill_and_restart(spark, tmp_path):
    """Killed in a chunk, after the last chunk, and with the stream's own notes lost: each chunk is worked on once to its end."""
    write_shards(spark, str(tmp_path / "shards"), range(5))
    done, validated, kills = [], [], {("work", 1), ("validate", 1)}

    def step(kind, number, out):
        if (kind, number) in kills:
            kills.remove((kind, number))
            raise RuntimeError("lost")
        out.append(number)

    def again(name="run"):
        run = make_run(spark, tmp_path, epochs=2, work=lambda rows, vocab, p: step("work", p, done), validate=lambda e, vocab: step("validate", e, validated))
        return run

    with pytest.raises(Exception, match="lost"):
        again().finish()
    assert done == [0] and commit_log.position(spark, again().log_path, 3) == (1, 2, False)
    with pytest.raises(Exception, match="lost"):
        again().finish()
    # All chunks are done, the validation is not: it comes before the next epoch.
    assert done == [0, 1, 2] and validated == [] and commit_log.position(spark, again().log_path, 3) == (2, 1, True)
    files.delete(spark, str(tmp_path / "run" / "stream"))
    # Files that came later belong to the next run.
    write_shards(spark, str(tmp_path / "shards"), [5, 6])
    again().finish()
    assert done == [0, 1, 2, 3, 4, 5] and validated == [1, 2]
    assert ids(again().vocab()) == expected(spark, SHARDS[:5])
    history = commit_log.history(again().log()).orderBy("epoch", "chunk").collect()
    assert [(r["epoch"], r["chunk"], r["validated"]) for r in history] == [(e, c, c == 3) for e in (1, 2) for c in (1, 2, 3)]
    with pytest.raises(commit_log.PositionError, match="chunk_total_changed"):
        commit_log.position(spark, again().log_path, 4)


def test_a_chunk_done_twice_gives_the_same(spark, tmp_path):
    """Killed between the vocabulary and the log: the version is written again, and whatever followed it is gone."""
    path, chunks = str(tmp_path / "vocab"), [["b"], ["a", "c"], [None, " "], ["d", "a"], ["b"]]
    frames = [distinct_labels(spark.createDataFrame([(x,) for x in c], "disease string"), "disease") for c in chunks]
    for number in (0, 1, 1, 2, 3, 2, 3, 3, 4):
        vocab = ingest.grow_vocab(frames[number], path, number)
    assert ids(vocab) == ids(vocab_increments.load(spark, path)) == {"b": 0, "a": 1, "c": 2, "d": 3}
    assert [len(ids(vocab_increments.load(spark, path, before=v))) for v in (1, 2, 3, 4, 9)] == [1, 3, 3, 4, 4]
    assert vocab_increments.load(spark, path, before=0) is None
    with pytest.raises(VocabularyError, match="ids 4 to 4"):
        vocab_increments.append(spark.createDataFrame([("x", 7)], "label string, label_id int"), path, 9)


def test_what_is_written_follows_the_new_labels(spark, tmp_path):
    """A large vocabulary and forty chunks of one new label each: the large part is never written again."""
    path = str(tmp_path / "vocab")
    vocab_increments.append(spark.range(5000).selectExpr("format_string('a%06d', id) as label", "cast(id as int) as label_id"), path, 0)
    for version in range(1, 41):
        vocab_increments.append(spark.createDataFrame([(f"b{version:03d}", 4999 + version)], "label string, label_id int"), path, version)
    sizes = [s.rows for s in vocab_increments._listed(spark, path)]
    assert sizes.count(5000) == 1 and sum(sizes) - 5000 <= 40 * 6
    live = vocab_increments.segments(spark, path)
    assert len(live) <= 8 and sum(s.rows for s in live) == 5040
    assert vocab_increments.load(spark, path).count() == 5040 and vocab_increments.load(spark, path, before=21).count() == 5020


def test_of_two_writers_one_goes_on(spark, tmp_path):
    path = str(tmp_path / "log")
    assert commit_log.last_entry(spark, path) == -1 and commit_log.read_log(spark, path).count() == 0
    entry = {"run_id": "r", "epoch": 1, "chunk": 1, "total_chunks": 9, "validated": False}
    assert commit_log.append(spark, path, -1, entry) == 0
    with pytest.raises(commit_log.LogConflict):
        commit_log.append(spark, path, -1, entry | {"chunk": 5})
    assert commit_log.append(spark, path, 0, entry | {"chunk": 2}) == 1
    assert [r["chunk"] for r in commit_log.read_log(spark, path).orderBy("entry").collect()] == [1, 2]
    assert commit_log.position(spark, path, 9) == (1, 3, False)
    with pytest.raises(KeyError, match="chnk"):
        commit_log.append(spark, path, 1, {"chnk": 1})
    # A draft that was never renamed is no entry.
    (tmp_path / "log" / ".entry-000000000002.json.abc").write_text("{")
    assert commit_log.last_entry(spark, path) == 1 and files.publish(spark, f"{path}/x", "a") and not files.publish(spark, f"{path}/x", "b")
    assert (tmp_path / "log" / "x").read_text() == "a"


def test_positions_of_the_source():
    reader = PlanReader(3, 5)
    assert [reader.initialOffset()] + [reader.latestOffset() for _ in range(4)] == [{"position": p} for p in (3, 4, 5, 5, 5)]
    parts = reader.partitions({"position": 3}, {"position": 5})
    assert [t for p in parts for t in reader.read(p)] == [(3,), (4,)]


def test_an_empty_folder_and_a_chunk_without_labels(spark, tmp_path):
    write_shards(spark, str(tmp_path / "shards"), [3])
    run = make_run(spark, tmp_path)
    assert run.plan.where(F.col("shard_id") > 5).isEmpty()
    none = ingest.Run(spark, run.plan.where("false"), run.source, SCHEMA, str(tmp_path / "none"))
    none.finish()
    assert none.log().count() == 0 and none.vocab() is None
    labels = distinct_labels(spark.createDataFrame([(None,), (" ",)], "disease string"), "disease")
    assert ingest.grow_vocab(labels, str(tmp_path / "empty"), 0) is None
