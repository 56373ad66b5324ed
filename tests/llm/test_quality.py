"""Pairwise ranking: features and gradients written out, the quantile, and accuracy on held-out documents."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tuneprep.llm import quality as Q
from tuneprep.llm.queries import QUERIES

TEXTS = [None, "", "a", "One two two.\nOne two two.\n", " \t\n", "WORD!! WORD!! x|y | z", "été 日本 12", "a b\n\nA b\na b", "x" * 5000, "y z " * 900]


def plain(text):
    data = (text or "").encode()
    pairs = np.zeros(Q.KINDS * Q.KINDS)
    for a, b in zip(data, data[1:], strict=False):
        pairs[Q.CLASS[a] * Q.KINDS + Q.CLASS[b]] += 1
    out = np.sqrt(pairs / max(1, len(data) - 1)).tolist()
    cuts = [[x for x in re.split(p, data) if x] for p in (rb"[\x20\x09-\x0d]+", rb"[\x0a\x0d]+")]
    lower = [[re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in c] for c in cuts]
    out += [(len(c) - len(set(c))) / max(1, len(c)) for c in lower]
    out += [np.log1p(len(data) / max(1, len(c))) for c in cuts]
    return [*out, np.log1p(len(data))]


def test_features_equal_plain_ones():
    expected = np.array([plain(t) for t in TEXTS])
    assert Q.features(pa.array(TEXTS)) == pytest.approx(expected, abs=1e-6)
    assert Q.features(pa.array(TEXTS[3:6])) == pytest.approx(expected[3:6], abs=1e-6)
    assert Q.features(pa.array([], pa.string())).shape == (0, Q.FEATURES)
    # Each byte has one class, and blanks, line ends, digits and letters have their own.
    assert len({Q.CLASS[ord(c)] for c in " \n0aA|!"}) == 7 and Q.CLASS[ord("b")] == Q.CLASS[ord("z")]


def test_gradient_of_the_pair_loss():
    rng = np.random.default_rng(1)
    x, weight = rng.standard_normal((30, 7)), rng.standard_normal(7)
    better, worse = rng.integers(0, 30, (2, 200))
    loss, gradient = Q.pair_loss(weight, x, better, worse, 0.01)
    differences = x[better] - x[worse]
    assert loss == pytest.approx(np.mean([np.log(1 + np.exp(-(d @ weight))) for d in differences]) + 0.01 * weight @ weight)
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        slope = (Q.pair_loss(weight + step, x, better, worse, 0.01)[0] - Q.pair_loss(weight - step, x, better, worse, 0.01)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-6)


def test_scores_follow_preferences_and_the_quantile():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 6))
    labels = (x[:, 0] - 2 * x[:, 3] + rng.logistic(size=3000) > -1).astype(int)
    model = Q.train(x, labels, np.ones(3000), cut=0.3, pairs=20_000)
    scores = model.score(x)
    true = np.array([1, 0, 0, -2, 0, 0])
    assert model.weight @ true / np.linalg.norm(model.weight) / np.linalg.norm(true) > 0.99
    # As many documents lie below the cut as have label 0.
    assert (scores < 0.3).sum() == (labels == 0).sum()
    # The score of a pair's difference is the probability of the preference.
    s = x @ model.weight
    assert np.log(scores / (1 - scores)) == pytest.approx(np.clip(s + model.offset, -50, 50), abs=1e-3)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op13_quality"](spark, folder).collect()}
    truth = duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet' where quality is not null").fetchall()
    assert len(got) == duckdb.sql(f"select count(*) from '{folder}/documents.parquet'").fetchall()[0][0]
    held = [(got[d]["predicted"], y) for d, y in truth if d in got and got[d]["held_out"]]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_edges(spark, tmp_path):
    def run(docs, labels):
        df = spark.createDataFrame(docs, "doc_id long, text string, score string, x array<float>, label int")
        df.repartition(2).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        df = spark.createDataFrame(labels, "doc_id long, quality int, text string")
        df.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return QUERIES["op13_quality"](spark, str(tmp_path)).collect()

    docs = [(i, t, "s", [1.0], 5) for i, t in enumerate(TEXTS * 3)] + [(None, "a b", "s", None, None), (3, TEXTS[3], "t", None, 0)]
    docs += [(100, "w" * 200_000, "s", None, 1), (101, "a, b. " * 50_000, "s", None, 1)]
    assert run([], []) == [] and run([], [(1, 1, "x")]) == []
    assert max(r["score"] for r in run(docs, [])) < 1e-9
    assert min(r["score"] for r in run(docs, [(i, 1, None) for i in range(30)])) > 1 - 1e-9
    labels = [(i, i % 2, None) for i in range(30)] + [(None, 1, "x"), (4, None, "x"), (7, 2, "x"), (999, 1, "x"), (3, 1, "x"), (3, 0, "x")]
    got = run(docs, labels)
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    # Equal texts have equal scores.
    by_text = {}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 30:
            by_text.setdefault(r["doc_id"] % len(TEXTS), set()).add(round(r["score"], 12))
    assert all(len(s) == 1 for s in by_text.values())


def noisy(spark, count, share, seed=7):
    """Documents whose labels follow the share of capitals, blurred; some without a label."""
    rng = np.random.default_rng(seed)
    capitals = rng.random(count)
    texts = ["".join(np.where(rng.random(40) < c, "A", rng.choice(list("ab ,."), 40))) for c in capitals]
    labels = (capitals + 0.3 * rng.standard_normal(count) > share).astype(int)
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    return texts, labels, documents, spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels) if i % 10], "id long, label int")


def test_all_labelled_documents_make_the_quantile(spark):
    # More of each label than were drawn before, when the quantile was that of 2,000 of each.
    texts, truth, documents, labels = noisy(spark, 6000, 0.5)
    learned = np.arange(6000) % 10 > 0
    assert min(np.bincount(truth[learned])) > 2400
    model = Q.fit(documents, labels)
    scores = model.score(Q.features(pa.array(texts)))[learned]
    assert (scores < Q.CUT).sum() == (truth[learned] == 0).sum()


def test_weights_minimise_the_loss_of_all_pairs(spark, monkeypatch):
    texts, truth, documents, labels = noisy(spark, 300, 0.4)
    monkeypatch.setattr(Q, "SETTLED", 1e-9)
    monkeypatch.setattr(Q, "MOST_STEPS", 60)
    model = Q.fit(documents, labels)
    learned = np.arange(300) % 10 > 0
    x, y = Q.features(pa.array(texts))[learned].astype(np.float64), truth[learned]
    spread = x.std(axis=0)
    used = spread > 1e-6
    better, worse = (a.ravel() for a in np.meshgrid(np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    z, weight = x[:, used] / spread[used], model.weight[used] * spread[used]
    loss, gradient = Q.pair_loss(weight, z, better, worse)
    start, first = Q.pair_loss(weight * 0, z, better, worse)
    assert loss < 0.9 * start and np.linalg.norm(gradient) < 0.005 * np.linalg.norm(first)
    assert (model.weight[~used] == 0).all()
    # Joined by a shuffle, the documents are the same and so is the model, and its order of tasks does not matter.
    monkeypatch.setattr(Q, "fits_broadcast", lambda table: False)
    again = Q.fit(documents.repartition(5), labels)
    assert again.weight == pytest.approx(model.weight, abs=1e-3) and again.offset == pytest.approx(model.offset, abs=1e-2)


def test_pulls_of_scores_on_the_grid():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 3, 200), np.append(rng.normal(-1, 3, 150), [-2000.0, 90.0])
    total, up, down = Q.pulls(Q._spread(good, np.ones(200)), Q._spread(bad, np.ones(152)))
    apart = good[:, None] - np.clip(bad, -Q.LIMIT, Q.LIMIT)
    assert total == pytest.approx(np.logaddexp(0, -apart).sum(), rel=1e-4)
    low, part = Q._on_grid(good)
    assert up[low] * (1 - part) + up[low + 1] * part == pytest.approx((1 / (1 + np.exp(np.clip(apart, -500, 500)))).sum(1), abs=1e-2)
    low, part = Q._on_grid(bad[:150])
    assert down[low] * (1 - part) + down[low + 1] * part == pytest.approx((1 / (1 + np.exp(np.clip(apart, -500, 500)))).sum(0)[:150], abs=1e-2)


def test_ranks_are_exact(spark):
    rng = np.random.default_rng(4)
    scores = np.concatenate([rng.standard_normal(500), [1e9, -1e9, 0.25, np.nextafter(0.25, 1)], np.full(50, 0.5)])
    times = rng.integers(1, 4, len(scores))
    table = spark.createDataFrame([(float(s), int(n)) for s, n in zip(scores, times, strict=True)], "score double, times long")
    order = np.sort(np.repeat(scores, times))
    for rank in (1, 2, len(order) // 2, int(np.searchsorted(order, 0.5)) + 3, int(np.searchsorted(order, 0.25)) + 1, len(order)):
        assert Q.at_rank(table, rank) == order[rank - 1]
