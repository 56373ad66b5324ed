"""Cover trees against all pairs."""

import numpy as np
import pytest

from tuneprep.llm import cover_tree as C


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1)[:, None]


@pytest.mark.parametrize("dimension", [2, 3, 8, 64])
@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_traversal_finds_exactly_the_pairs(dimension, threshold):
    rng = np.random.default_rng(dimension)
    centres = rng.standard_normal((6, dimension))
    spread = rng.choice([0.02, 0.1, 0.5], (250, 1))
    one = unit(np.concatenate([centres[rng.integers(0, 6, 250)] + rng.standard_normal((250, dimension)) * spread, rng.standard_normal((20, dimension))]))
    two = unit(np.concatenate([centres[rng.integers(0, 6, 80)] + rng.standard_normal((80, dimension)) * 0.1, one[:5]]))
    a, b = (C.Tree(x, C.owners(x)) for x in (one, two))
    for x, y, same in ((a, b, False), (a, a, True)):
        singles, wholes = C.traverse(x, y, threshold, same)
        pairs = [(int(i), int(j)) for s in singles for i, j in zip(*s, strict=True)]
        pairs += [(i, j) for b1, e1, b2, e2 in wholes for i in range(b1, e1) for j in range(b2, e2)]
        near = x.vectors @ y.vectors.T >= threshold
        expected = np.nonzero(np.triu(near, 1) if same else near)
        assert sorted(pairs) == sorted(zip(*map(np.ndarray.tolist, expected), strict=True))


def test_levels_are_nested_and_cover():
    vectors = unit(np.random.default_rng(0).standard_normal((300, 3)))
    owners = C.owners(vectors)
    for level, radius in enumerate(2.0 / 2 ** np.arange(len(owners))):
        centres = np.unique(owners[level])
        assert (owners[level][centres] == centres).all()
        assert (np.linalg.norm(vectors - vectors[owners[level]], axis=1) <= radius + 1e-9).all()
        if level:
            assert set(np.unique(owners[level - 1])) <= set(centres.tolist())
            assert (owners[level - 1][owners[level]] == owners[level - 1]).all()


def test_blocks_copies_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 6))
    rows = [(i, (base[i % 40] + 0.05 * rng.standard_normal(6) * (i % 3)).tolist()) for i in range(400)]
    rows += [(i, base[0].tolist()) for i in range(500, 540)] + [rows[7], (900, None), (901, [0.0] * 6), (None, base[1].tolist()), (902, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = C.near_duplicates(df, block=64).collect()
    assert len(got) == len(rows)
    sound = [i for i, (_, v) in enumerate(rows) if v is not None and any(v)]
    links = {i: [] for i in range(len(rows))}
    for i in sound:
        for j in sound:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links[i].append(j)
    component = {}
    for i in range(len(rows)):
        if i not in component:
            group, stack = {i}, [i]
            while stack:
                new = set(links[stack.pop()]) - group
                group |= new
                stack += new
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            component |= {k: min(ids) if ids else None for k in group}
    expected = sorted((str(rows[i][0]), len(links[i]), str(component[i])) for i in range(len(rows)))
    assert sorted((str(r["id"]), r["n_links"], str(r["component_id"])) for r in got) == expected


def clusters(groups, members, scattered, dimension=16, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    centres = unit(rng.standard_normal((groups, dimension)))
    near = np.repeat(centres, members, axis=0) + spread * rng.standard_normal((groups * members, dimension)) / np.sqrt(dimension)
    return np.concatenate([unit(near), unit(rng.standard_normal((scattered, dimension)))])


def brute(vectors, threshold):
    near = vectors @ vectors.T >= threshold
    np.fill_diagonal(near, False)
    component = np.arange(len(vectors))
    while True:
        lowest = np.minimum(component, np.where(near, component[None, :], len(vectors)).min(1))
        if (lowest == component).all():
            return near.sum(1), component
        component = lowest


@pytest.mark.parametrize("threshold, spread", [(0.9, 0.05), (0.5, 0.6), (0.97, 0.3)])
def test_blocks_by_centre_give_all_links(spark, threshold, spread):
    vectors = clusters(12, 60, 80, spread=spread)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    got = sorted(map(tuple, C.near_duplicates(df, threshold, block=32).select("id", "n_links", "component_id").collect()))
    links, component = brute(np.stack([np.array(v.tolist()) for v in vectors]), threshold)
    assert got == list(zip(range(len(vectors)), links.tolist(), component.tolist(), strict=True))


def classes_of(spark, vectors):
    rows = [(i, len(v), 1, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "class long, dimension int, weight long, vector array<double>")


def test_far_blocks_never_meet(spark):
    """Vectors in clusters are copied as often however many clusters there are; by hash each would go to all blocks."""
    for groups in (10, 40):
        vectors = clusters(groups, 50, 0, dimension=64)
        dealt, ways = C.deal(classes_of(spark, vectors), 0.9, 32)
        blocks = dealt.select("block").distinct().count()
        copies = C.meetings(dealt, ways).count() / len(vectors)
        assert blocks >= 2 * groups
        assert copies <= 3


def test_blocks_hold_no_more_than_asked_for_a_hot_centre(spark):
    vectors = clusters(1, 1500, 100, dimension=32)
    dealt, ways = C.deal(classes_of(spark, vectors), 0.9, 128)
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert sum(sizes) == 1600 and max(sizes) < 2 * 128


def test_scattered_vectors_have_no_centre(spark):
    vectors = clusters(0, 0, 400, dimension=64)
    dealt, ways = C.deal(classes_of(spark, vectors), 0.9, 64)
    assert {r["key"] for r in ways.collect()} == {"64:-1"}
    assert dealt.count() == 400
