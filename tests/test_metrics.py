import random

import pytest

from tuneprep.operators import metrics


def pairs_of(spark, true, pred):
    rows = list(zip(true, pred))
    return metrics.confusion(spark.createDataFrame(rows, "true_id int, pred_id int"))


def classes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "label_id int")


def by_hand(true, pred, ids):
    """Macro, micro and weighted figures by counting."""
    ids = [i for i in ids if i >= 0]
    tp = {i: sum(t == p == i for t, p in zip(true, pred)) for i in ids}
    said = {i: pred.count(i) for i in ids}
    real = {i: true.count(i) for i in ids}

    def ratio(a, b):
        return a / b if b else 0.0

    each = {
        "precision": {i: ratio(tp[i], said[i]) for i in ids},
        "recall": {i: ratio(tp[i], real[i]) for i in ids},
        "f1": {i: ratio(2 * tp[i], said[i] + real[i]) for i in ids},
    }
    out = {"accuracy": sum(t == p for t, p in zip(true, pred)) / len(true)}
    for name, values in each.items():
        out[f"macro_{name}"] = sum(values.values()) / len(ids)
        out[f"weighted_{name}"] = ratio(sum(values[i] * real[i] for i in ids), sum(real.values()))
    hits, n_said, n_real = sum(tp.values()), sum(said.values()), sum(real.values())
    out["micro_precision"], out["micro_recall"] = ratio(hits, n_said), ratio(hits, n_real)
    out["micro_f1"] = ratio(2 * hits, n_said + n_real)
    return out


CASES = {
    "unknown and no support": ([0, 0, 1, 1, 2], [0, -1, 1, 0, -1], [0, 1, 2, 3]),
    "one class": ([4, 4], [4, -1], [4]),
    "nothing right": ([0, 1], [1, 0], [0, 1]),
    "all unknown": ([0, 1], [-1, -1], [0, 1]),
    "class not scored": ([0, 1, 2], [0, 2, 2], [0, 1]),
    "negative class ignored": ([0, 1], [0, -1], [-1, 0, 1]),
}


@pytest.mark.parametrize("case", CASES)
def test_figures(spark, case):
    true, pred, ids = CASES[case]
    got = metrics.classification_metrics(pairs_of(spark, true, pred), classes(spark, ids)).first()
    for name, value in by_hand(true, pred, ids).items():
        assert got[name] == pytest.approx(value, abs=1e-12), name
    assert got["num_samples"] == len(true)
    assert got["unknown_predictions"] == pred.count(-1)


def test_random_figures(spark):
    rng = random.Random(3)
    true = [min(rng.randint(0, 12), 5) for _ in range(3000)]
    pred = [t if rng.random() < 0.6 else rng.randint(-1, 12) for t in true]
    got = metrics.classification_metrics(pairs_of(spark, true, pred)).first()
    for name, value in by_hand(true, pred, sorted(set(true))).items():
        assert got[name] == pytest.approx(value, abs=1e-12), name


@pytest.mark.parametrize(
    "true, pred, ids, message",
    [
        ([], [], [0], "no rows"),
        ([0, -1], [0, 0], [0], "negative"),
        ([0, None], [0, 0], [0], "lack"),
        ([0], [None], [0], "lack"),
        ([0], [0], [-1], "no valid classes"),
    ],
)
def test_guards(spark, true, pred, ids, message):
    with pytest.raises(metrics.MetricsError, match=message):
        metrics.guard(pairs_of(spark, true, pred), classes(spark, ids))
