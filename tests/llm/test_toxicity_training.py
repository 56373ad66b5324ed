"""Toxicity learned from all labelled documents: sums of tasks against the training in memory, and how bags are kept."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tuneprep.llm import toxicity as T


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = ["stone", "river", "paper", "window", "garden", "yellow", "simple", "travel"]
    texts = [" ".join(rng.choices(words, k=12) + rng.choices(["worthless", "disgusting"], k=2 * (i % 3 == 0))) for i in range(200)]
    texts[7] = ""
    documents = [(i, t) for i, t in enumerate(texts)] + [(None, "river"), (201, None), (202, "unlabelled")]
    labels = [(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (201, 1), (999, 1), (3, None), (4, 2)]
    return texts, spark.createDataFrame(documents, "id long, text string"), spark.createDataFrame(labels, "id long, label int")


def in_memory(texts):
    truth = np.array([i % 3 == 0 for i in range(len(texts))], float)
    model = T.train(texts, truth, np.where(truth == 1, T.MISSED, 1.0), steps=T.STEPS)
    return model.weight, model.offset


def test_all_documents_without_a_text_on_the_driver(spark, tables, monkeypatch):
    """Before, a sample of texts was sent to the driver and its bags were kept there, beside the training."""
    texts, documents, labels = tables
    monkeypatch.setattr(T, "STEPS", 8)
    expected, offset = in_memory(texts)

    def never(*_):
        raise AssertionError("a sample of texts for the driver")

    for name in ("sample", "within_bytes", "train"):
        monkeypatch.setattr(T, name, never)
    weight, found = T.fit(documents, labels)
    assert np.abs(weight - expected).max() < 1e-3 * np.abs(expected).max() and found == pytest.approx(offset, abs=1e-3)
    assert (weight != 0).sum() == (expected != 0).sum() > 10
    # Other tasks, and a join by a shuffle, give the very same model.
    monkeypatch.setattr(T, "fits_broadcast", lambda table: False)
    again, shuffled = T.fit(documents.repartition(5), labels)
    assert (again == weight).all() and shuffled == found


def test_batches_are_parts_of_all_documents(spark, tables, monkeypatch):
    texts, documents, labels = tables
    known = labels.where("id is not null and label in (0, 1)")
    monkeypatch.setattr(T, "PER_BATCH", 20)
    rows, batches = T._learned(documents, known)
    assert batches == 3
    stored = T._stored(T._bagged(rows), "bags")
    assert stored.count() == 200 and {r["batch"] for r in stored.collect()} == {0, 1, 2}
    assert stored.agg({"good": "sum", "bad": "sum"}).first().asDict() == {"sum(good)": 67, "sum(bad)": 133}
    scores = np.random.default_rng(1).standard_normal(T.BUCKETS).astype(np.float32) / 50
    weights = np.zeros(3)
    for r in stored.collect():
        weights[r["batch"]] += r["good"] * T.MISSED + r["bad"]
    pull = T._pull(stored, 3, T.BUCKETS)
    parts = [pull(scores, 0.1) for _ in range(3)]
    whole, wrong = T._pull(stored.selectExpr("good", "bad", "total", "bag", "0 as batch"), 1, T.BUCKETS)(scores, 0.1)
    share = weights / weights.sum()
    assert sum(s * g for s, (g, _) in zip(share, parts, strict=True)) == pytest.approx(whole, abs=1e-9)
    # The gradient written out.
    row, at, part = T.bags(texts)
    truth = np.array([i % 3 == 0 for i in range(200)], float)
    z = T.SCALE * np.bincount(row, part * scores[at], 200) + 0.1
    each = np.where(truth == 1, T.MISSED, 1.0) * (1 / (1 + np.exp(-z)) - truth) / (67 * T.MISSED + 133)
    assert whole == pytest.approx(np.bincount(at, T.SCALE * part * each[row], T.BUCKETS), abs=1e-5) and wrong == pytest.approx(each.sum(), abs=1e-6)


@pytest.mark.parametrize("entries", [1 << 18, 100])
def test_bags_are_read_as_written(monkeypatch, entries):
    monkeypatch.setattr(T, "ENTRIES", entries)
    rng = np.random.default_rng(0)
    at = [[], [T.FAR, 2 * T.FAR, 3 * T.FAR + 1], [], np.sort(rng.choice(T.BUCKETS, 500, replace=False)), [0], np.arange(9000), [0, T.BUCKETS - 1], []]
    at = [np.array(a, np.int64) for a in at]
    times = [rng.integers(1, 4, len(a)) for a in at]
    times[1], times[4], times[6] = np.array([2 * T.MANY, 2 * T.MANY + 1, 1]), np.array([100_000]), np.array([T.MANY, T.MANY + 1])
    offsets = np.cumsum([0, *map(len, at)])
    one = np.ones(len(at), np.int64)
    record = T._record(T._Bags(one, one, one, pa.array([0] * len(at), pa.int32()), offsets, np.concatenate(at), np.concatenate(times)))
    for batches in ([record], [record.slice(0, 3), record.slice(3), record.slice(8)]):
        got = [(b.at[i:j], b.times[i:j]) for b in T._read(batches) for i, j in zip(b.offsets[:-1], b.offsets[1:], strict=True)]
        for (a, n), x, y in zip(got, at, times, strict=True):
            assert (np.bincount(a, n, T.BUCKETS) == np.bincount(x, y, T.BUCKETS)).all()
        spread = sum(np.bincount(b.buckets(), minlength=T.BUCKETS) for b in T._read(batches))
        assert (spread == np.bincount(np.concatenate(at), minlength=T.BUCKETS)).all()
    numbers = np.array([0, 1, -1, 1 << 40, -(1 << 61), 12345])
    assert (T._unpacked(T._packed(numbers)) == numbers).all()


def test_long_texts_have_the_bag_of_their_pieces(monkeypatch):
    text = " ".join("".join(random.Random(i).choices("abcdé-", k=i % 9)) for i in range(300)) + " " + "w" * 200 + " end"
    row, bucket, times = T.counts([text])
    monkeypatch.setattr(T, "PIECE", 50)
    pieces = list(T._pieces(text))
    assert len(pieces) > 20 and "".join(pieces) == text
    whole = sum(np.bincount(b, n, T.BUCKETS) for _, b, n in map(T.counts, ([p] for p in pieces)))
    assert (whole == np.bincount(bucket, times, T.BUCKETS)).all()
    assert list(T._pieces("")) == []
