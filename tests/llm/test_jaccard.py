"""The Jaccard join: what of the prefixes is shuffled, and all links between near copies."""

import numpy as np

from tuneprep.llm import jaccard as J


def test_only_prefixes_of_compared_sets_are_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(400)]
    # Of three texts there are near copies: one or two words at the end.
    copies = [(1000 + i, f"{texts[i]} x{i}") for i in range(3)] + [(2000 + i, f"{texts[i]} x{i} y{i}") for i in range(3)]
    documents = spark.createDataFrame([*enumerate(texts), *copies], "id long, text string").repartition(4)
    plain, passed = J._only, []

    def spied(rows, wanted, key):
        out = plain(rows, wanted, key)
        wanted_keys = {r[0] for r in wanted.collect()}
        passed.append((key, wanted_keys, {r[0] for r in out.select(key).collect()}, rows.count()))
        return out

    monkeypatch.setattr(J, "_only", spied)
    monkeypatch.setattr(J, "LONG", 2)
    got = {r["id"]: r["component_id"] for r in J.similar(documents).collect()}
    assert got == {i: i for i in range(400)} | {1000 + i: i for i in range(3)} | {2000 + i: i for i in range(3)}
    for _, wanted, found, rows in passed:
        # All that is wanted, and hardly any of the others.
        assert wanted & found == wanted or rows == 0
        assert len(found - wanted) <= 0.1 * rows
    # Before, the prefixes of all sets went to each comparison.
    assert any(key == "set" and found for key, _, found, _ in passed)
    assert all(len(found) < 60 and rows == 406 for key, _, found, rows in passed if key == "set")


def test_filters_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{i}" for i in range(300)], 80)) for _ in range(12)]
    texts = [f"{base[i % 12]} {' '.join(f'z{k}' for k in range(i // 12))}" for i in range(96)]
    documents = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)

    def run():
        return sorted(map(tuple, J.similar(documents).collect()))

    monkeypatch.setattr(J, "LONG", 4)
    got = run()
    monkeypatch.setattr(J, "_only", lambda rows, wanted, key: rows)
    assert got == run()
    assert {c for _, _, c in got} == set(range(12))
