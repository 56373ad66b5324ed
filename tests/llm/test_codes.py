"""Codes of vectors against plain distances."""

import numpy as np
import pytest

from tuneprep.llm import codes as C


@pytest.mark.parametrize("leaves", [1, 3, 50, 10_000])
def test_trie_gives_the_nearest_entries(leaves):
    rng = np.random.default_rng(leaves)
    for width, kinds in ((1, 5), (3, 3), (4, 2000)):
        values, place = C._distinct(rng.integers(-kinds, kinds, (600, width)))
        assert (values == np.array(sorted(set(map(tuple, values.tolist()))))).all() and place.max() == len(values) - 1
        entries = rng.integers(-kinds, kinds, (16, width))
        entries[9] = entries[2]
        index, distance = C.nearest(values, entries, leaves)
        plain = ((values[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert [len(x) for x in C.nearest(np.zeros((0, 3), np.int64), entries[:, :3])] == [0, 0]


def plain_codes(rows, rounds=6):
    """rows: id and vector, all of one length. Python numbers and loops only."""
    numbers = [[int(np.floor(4096 * float(x))) for x in v] for _, v in rows]
    width = len(numbers[0]) // 8
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, numbers[i]))[:16]
    parts = [[n[p * width : (p + 1) * width] for n in numbers] for p in range(8)]
    books = [[parts[p][i] for i in order] for p in range(8)]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for r in range(rounds + 1):
        near = [[min(range(len(books[p])), key=lambda e: (away(x, books[p][e]), e)) for x in parts[p]] for p in range(8)]
        if r < rounds:
            for p in range(8):
                for e in set(near[p]):
                    mine = [x for x, n in zip(parts[p], near[p], strict=True) if n == e]
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    code = ["".join(f"{near[p][i]:02x}" for p in range(8)) for i in range(len(rows))]
    return code, [sum(away(parts[p][i], books[p][near[p][i]]) for p in range(8)) for i in range(len(rows))], books


@pytest.mark.parametrize("count", [1, 7, 16, 300])
def test_codes_equal_plain_ones(spark, count):
    rng = np.random.default_rng(count)
    base = rng.standard_normal((max(1, count // 3), 24))
    rows = [(i if i % 50 else None, base[rng.integers(0, len(base))].tolist(), "x") for i in range(count)]
    # Equal ids, a hot vector, large and negative numbers.
    rows += [(1, rows[0][1], "y")] * 3 + [(5000, [-1000.25] * 24, "z"), (5001, [1000.0] * 24, "z")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, code string").repartition(3)
    vectors = C.integers(df)
    books = C.fit(vectors)
    code, error, expected = plain_codes([r[:2] for r in rows])
    assert [b.tolist() for b in books] == expected
    got = C.encode(vectors, books).collect()
    assert sorted((str(r["id"]), r["code"], r["error"]) for r in got) == sorted((str(r[0]), c, e) for r, c, e in zip(rows, code, error, strict=True))
    decoded = C.decode([r["code"] for r in got], books)
    assert ((decoded - np.array([r["values"] for r in got])) ** 2).sum(axis=1).tolist() == [r["error"] for r in got]


def test_vectors_that_cannot_be_coded(spark):
    odd = [None, [], [1.0] * 7, [1.0] * 16, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("-inf")] + [0.0] * 7]
    rows = [(i, v) for i, v in enumerate(odd, 10)] + [(1, [0.5] * 8), (None, [0.25] * 8)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    assert sorted((str(r["id"]), r["values"]) for r in C.integers(df).collect()) == [("1", [2048] * 8), ("None", [1024] * 8)]
    assert C.integers(df.where("id > 100")).isEmpty() and C.fit(C.integers(df.where("id > 100"))) == []
    assert C.encode(C.integers(df.where("id > 100")), []).count() == 0
    with pytest.raises(Exception, match="too large"):
        C.integers(spark.createDataFrame([(1, [1e300] * 8)], "id long, vector array<double>")).collect()


def test_parts_in_order_share_tasks_and_rounds_collect_sums_only(spark, folder):
    vectors = C.integers(spark.read.parquet(f"{folder}/embeddings.parquet").withColumnsRenamed({"vec_id": "id", "embedding": "vector"}))
    size = len(vectors.first()["values"])
    out = vectors.mapInArrow(lambda b: C._sums(iter([]), [np.zeros((16, size // 8), np.int64)] * 8), C._SUMS)
    assert out.count() == 0
