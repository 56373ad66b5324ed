"""The trained models: gradients, held-out accuracy, defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tuneprep.llm import language, toxicity
from tuneprep.llm.queries import QUERIES
from tuneprep.llm.words import text_bytes

FOLDER = "/root/testdata/sf0.01"


def held_out(doc_id, divisor, remainder):
    return zlib.crc32(str(doc_id).encode()) % divisor == remainder


def test_backpropagation_through_time():
    rng = np.random.default_rng(0)
    net = language.Network.fresh(["a", "b", "c"], 3, 1)
    for name in ("inputs", "recurrent", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, counted, labels = rng.integers(60, 70, (6, 4)), rng.random((6, 4)) > 0.2, np.array([0, 1, 2, 1])
    _, found = language.gradients(net, windows, counted, labels)
    for weight, gradient in zip(net.weights(), found, strict=True):
        for at in list(np.ndindex(weight.shape))[:: max(1, weight.size // 40)]:
            old, sides = weight[at], []
            for step in (1e-5, -1e-5):
                weight[at] = old + step
                sides.append(language.gradients(net, windows, counted, labels)[0])
            weight[at] = old
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(gradient[at], abs=1e-7)


def test_document_probabilities_are_means_over_letters():
    net = language.Network.fresh(["a", "b"], 4, 2)
    texts = ["", "abc", "x" * 1000 + " ", "é 12", "ab" * 200_000, "z", ""]
    data, offsets = text_bytes(pa.array(texts))
    got = language.document_probabilities(net, data, offsets)
    for i, text in enumerate(texts):
        raw = text.encode()
        total, letters = np.zeros(2), 0
        for start in range(0, min(len(raw), 2000), language.WINDOW):
            window = np.frombuffer(raw[start : start + language.WINDOW].ljust(language.WINDOW, b"\0"), np.uint8).astype(np.intp)
            counted = language.LETTERS[window] & (np.arange(language.WINDOW) < len(raw) - start)
            total += (language.positions(net, window[:, None])[:, :, 0] * counted[:, None]).sum(0)
            letters += counted.sum()
        expected = total / max(1, letters)
        assert got[i] == pytest.approx(expected, abs=2e-3 if len(raw) > 2000 else 1e-5)


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op3_language"](spark, FOLDER).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    tested = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held_out(r["doc_id"], 4, 2) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in tested]) > 0.97


def test_language_cases(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(w, k=30)), x) for i in range(60) for x, w in [("en", "the and with house".split()), ("de", "der über schön straße".split())]]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 !?", "de"), (503, "日本", None), (None, "the house", "xx"), (1, "the house", "en")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    net = language.fit(df)
    assert net.languages == ["de", "en"]
    got = [(r["id"], r["lang_pred"], r["score"]) for r in language.identify(df.select("id", "text"), net).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    by_id = {i: x for i, x, _ in got}
    assert [by_id[i] for i in (500, 501, 502)] == ["und"] * 3 and by_id[503] in ("de", "en")
    empty = df.where("id < 0")
    assert language.fit(empty).languages == []
    assert {r["lang_pred"] for r in language.identify(df.select("id", "text"), language.fit(empty)).collect()} == {"und"}
    assert language.identify(empty.select("id", "text"), net).count() == 0


def test_sums_are_means_over_the_bag():
    rng = random.Random(2)
    texts = ["", "a", "Hello, wörld! x-y 123", " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(500)), "--", "Ω" * 50]
    weight = np.random.default_rng(0).standard_normal(1 << 10)
    row, bucket, share = toxicity.bags(texts, buckets=1 << 10)
    expected = np.bincount(row, weights=share * weight[bucket], minlength=len(texts))
    assert toxicity.sums(texts, weight) == pytest.approx(expected, abs=1e-9)
    words = [w for w in texts[2].lower().replace(",", " ").replace("!", " ").replace("-", " ").split()]
    grams = {n: sum(max(0, len(w) + 2 - n + 1) for w in words) for n in toxicity.SIZES}
    one, _, parts = toxicity.bags([texts[2]], buckets=1 << 20)
    assert len(one) <= sum(grams.values()) and parts.sum() == pytest.approx(1)


def test_toxic_documents_held_out(spark):
    """On the small table few labels are known; planted words that a third of the toxic documents lack bound the recall."""
    rows = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert len(rows) == 10000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    tested = [(rows[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if held_out(r["doc_id"], 5, 0)]
    hits = sum(p and t for p, t in tested)
    assert hits / sum(p for p, _ in tested) > 0.85 and hits / sum(t for _, t in tested) > 0.75


def test_misspellings_share_vectors(spark):
    rng = random.Random(3)
    filler = ["stone", "river", "paper", "window", "garden", "yellow", "simple", "travel", "moment", "silver"]
    def text(bad):
        words = rng.choices(filler, k=20)
        return " ".join(words + rng.choices(["worthless", "disgusting"], k=2)) if bad else " ".join(words)
    docs = [(i, text(i % 2)) for i in range(300)]
    documents = spark.createDataFrame(docs + [(900, None), (901, "")], "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(900, 1), (5, None), (777, 1)], "id long, label int")
    model = toxicity.fit(documents, labels)
    asked = spark.createDataFrame([(1, "stone river worthlesss paper garden"), (2, "stone river paper garden"), (3, None), (4, "")], "id long, text string")
    got = {r["id"]: r["score"] for r in toxicity.score(asked, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4]
    none = toxicity.fit(documents, labels.where("label = 0"))
    assert {r["score"] < 1e-6 for r in toxicity.score(asked, none).collect()} == {True}
    assert toxicity.score(asked.where("id < 0"), model).count() == 0
