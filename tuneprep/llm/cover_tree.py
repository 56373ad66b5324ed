"""Embedding near-duplicates: dual traversal of cover trees.

Unit vectors are dealt into blocks of bounded size: by the nearest centre of an upper
level of a cover tree, drawn from a bounded sample, or, where no centre is near, by
hash. Blocks whose centres are too far apart for their covering radii never meet,
and are not copied to one another; blocks without a centre meet all. Each block is a cover tree:
levels of nested centres with halving radii (2, 1, 1/2, ...), where each centre of a
level lies within the radius of one of the level above, and each node knows the
exact distance of its farthest descendant. Two trees are traversed together: a pair
of nodes is dropped when their centres are too far apart for any two descendants to
be near, counted whole when they are so close that all descendants are near, and
otherwise split into pairs of children; pairs of vectors are compared by cosine in
double precision. So every pair at the threshold or above is found, and none below.

A task gives the number of links of each vector, and links that span the components
of its two blocks, not the pairs. Equal vectors are one, with a weight.

Defined cases. Null, empty and zero vectors and those with null or non-finite
components link with nothing. Vectors of another length than one another are never
linked. Repeated rows with one id are rows of their own with as many links; a null id
is no smallest id unless all are null. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tuneprep.llm.components import components
from tuneprep.operators.joins import lookup_join
from tuneprep.session import materialise

THRESHOLD = 0.9
# Vectors of a block, about; bounds the memory of a task.
BLOCK = 4096
# The vectors that the upper level is drawn from, about, in each dimension; they decide on blocks and not on results.
SAMPLE = 4096
# Centres of the upper level in all dimensions together, those with most vectors; and the radius of that level.
CENTRES = 1024
NEAR = 1 / 2
# A centre needs so many vectors of the sample, and by them so large a part of a block.
LEAST_SAMPLED, LEAST_PART = 4, 1 / 4
# Blocks are numbered below their centre.
_BELOW = 1 << 40
# The smallest radius of a level; closer vectors hang below one centre.
FINEST = 1 / 16
# Pairs of nodes looked at at a time.
STEP = 1 << 19
SLACK = 1e-9


class Tree:
    """A cover tree over unit vectors (rows), with rows reordered so that the descendants of a node are neighbours.

    owners: for each level the row of the centre that each row belongs to. levels[i]
    holds the nodes of a level as arrays: centre (a place in vectors), begin and end
    (its descendants), reach (distance of the farthest), first and last (its children in levels[i + 1]).
    """

    def __init__(self, vectors: np.ndarray, owners: np.ndarray):
        # Rows in the order of their node at each level; a node's rows are then neighbours at all levels.
        self.order = np.lexsort(owners[::-1])
        self.vectors = np.ascontiguousarray(vectors[self.order])
        self.rough = self.vectors.astype(np.float32)
        place = np.empty(len(vectors), np.int64)
        place[self.order] = np.arange(len(vectors))
        self.levels = []
        for owner in owners:
            owner = owner[self.order]
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            centre = place[owner[begin]]
            reach = np.maximum.reduceat(self._distance(place[owner]), begin)
            self.levels.append({"centre": centre, "begin": begin, "end": np.append(begin[1:], len(owner)), "reach": reach})
        for level, below in zip(self.levels, [*self.levels[1:], None], strict=True):
            starts = np.arange(len(vectors)) if below is None else below["begin"]
            level["first"] = np.searchsorted(starts, level["begin"])
            level["last"] = np.searchsorted(starts, level["end"])

    def _distance(self, centre: np.ndarray) -> np.ndarray:
        """The distance of each vector from the vector at a place."""
        return np.sqrt(np.maximum(0, ((self.vectors - self.vectors[centre]) ** 2).sum(1)))


def owners(vectors: np.ndarray, finest: float = FINEST) -> np.ndarray:
    """For each level, of radius 2, 1, 1/2 and so on, the row of the centre that each row belongs to."""
    found, radius = [np.zeros(len(vectors), np.int64)], 2.0
    while radius > finest:
        radius /= 2
        found.append(_covered(vectors, radius, found[-1]))
    return np.stack(found)


def _covered(vectors: np.ndarray, radius: float, parent: np.ndarray) -> np.ndarray:
    """The centre of each row at a level. Centres of the level above stay centres.

    A row belongs to a centre below its own node, so that levels are nested. Rows
    alone in their node are done. In each round the first uncovered rows are
    candidates; among them a greedy pass keeps those that no earlier one covers, and
    the kept ones cover other rows.
    """
    near = 1 - radius * radius / 2
    owner = np.where(np.bincount(parent, minlength=len(parent))[parent] == 1, np.arange(len(parent)), -1)
    rows = np.flatnonzero(owner < 0)
    best = np.full(len(parent), -np.inf)

    def cover(candidates: np.ndarray) -> None:
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            cosine = vectors[some] @ vectors[candidates].T
            cosine[parent[some][:, None] != parent[candidates][None, :]] = -np.inf
            top = cosine.argmax(1)
            value = cosine[np.arange(len(top)), top]
            better = (value >= near) & (value > best[some])
            owner[some] = np.where(better, candidates[top], owner[some])
            best[some] = np.where(better, value, best[some])
        owner[candidates] = candidates
        best[candidates] = np.inf

    upper = np.unique(parent[rows])
    for at in range(0, len(upper), 512):
        cover(upper[at : at + 512])
    while len(left := rows[owner[rows] < 0]):
        left = left[:512]
        cosine = vectors[left] @ vectors[left].T
        close = (cosine >= near) & (parent[left][:, None] == parent[left][None, :])
        kept = np.zeros(len(left), bool)
        for i in range(len(left)):
            kept[i] = not (close[i, :i] & kept[:i]).any()
        cover(left[kept])
    return owner


def _children(level: dict, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return level["first"][nodes], level["last"][nodes]


class _Union:
    """Sets of numbers, named by their smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def traverse(one: Tree, two: Tree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[tuple[int, int, int, int]]]:
    """All pairs of a vector of one and one of two with cosine >= threshold: vector pairs, and whole node pairs.

    Gives the places of single pairs (in one, in two) as lists of arrays, and of node pairs as
    (begin, end) in both. With same, two is one, and each unordered pair comes once, without loops.
    """
    far = math.sqrt(max(0.0, 2 - 2 * threshold))
    singles: list[tuple[np.ndarray, np.ndarray]] = []
    wholes: list[tuple[int, int, int, int]] = []
    depth = len(one.levels)
    # The root pair is split at once, in tiles, into all pairs of nodes of a level: the last one that has not many more
    # nodes than the first below the root, as such levels prune little. Nodes of one vector, most of them in
    # scattered data, share one bound; the bound of a tile is loose, in single precision.
    nodes = [len(x["centre"]) + len(y["centre"]) for x, y in zip(one.levels, two.levels, strict=True)]
    top = max(i for i in range(depth) if nodes[i] <= 2 * nodes[min(1, depth - 1)])
    a, b = one.levels[top], two.levels[top]
    stack: list[tuple[int, np.ndarray, np.ndarray]] = []
    kinds_a, kinds_b = ([np.flatnonzero(x["reach"] == 0), np.flatnonzero(x["reach"] > 0)] for x in (a, b))
    for rows_b in kinds_b:
        towards = two.rough[b["centre"][rows_b]].T
        for rows_a in kinds_a:
            if not len(rows_a) or not len(rows_b):
                continue
            for at in range(0, len(rows_a), 512):
                rows = rows_a[at : at + 512]
                cosine = one.rough[a["centre"][rows]] @ towards
                bound = min(2.0, far + a["reach"][rows].max() + b["reach"][rows_b].max())
                i, j = np.nonzero(cosine >= 1 - bound * bound / 2 - 1e-4)
                i, j = rows[i], rows_b[j]
                if same:
                    i, j = i[j >= i], j[j >= i]
                if len(i):
                    stack.append((top, i, j))
    while stack:
        depth_now, i, j = stack.pop()
        if len(i) > STEP:
            stack += [(depth_now, i[k : k + STEP], j[k : k + STEP]) for k in range(0, len(i), STEP)]
            continue
        if depth_now == depth:
            keep = np.einsum("ij,ij->i", one.vectors[i], two.vectors[j]) >= threshold
            if same:
                keep &= i < j
            singles.append((i[keep], j[keep]))
            continue
        a, b = one.levels[depth_now], two.levels[depth_now]
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", one.vectors[a["centre"][i]], two.vectors[b["centre"][j]])))
        spread = a["reach"][i] + b["reach"][j]
        keep = gap <= far + spread + SLACK
        whole = keep & (gap + spread <= far - 1e-7)
        if same:
            whole &= i != j
        for x, y in zip(i[whole], j[whole], strict=True):
            wholes.append((a["begin"][x], a["end"][x], b["begin"][y], b["end"][y]))
        i, j = i[keep & ~whole], j[keep & ~whole]
        first_a, last_a = _children(a, i)
        first_b, last_b = _children(b, j)
        counts = (last_a - first_a) * (last_b - first_b)
        if len(i) > 1 and counts.sum() > 8 * STEP:
            half = len(i) // 2
            stack += [(depth_now, i[:half], j[:half]), (depth_now, i[half:], j[half:])]
            continue
        pair = np.repeat(np.arange(len(i)), counts)
        number = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
        width = (last_b - first_b)[pair]
        left, right = first_a[pair] + number // np.maximum(width, 1), first_b[pair] + number % np.maximum(width, 1)
        if same:
            left, right = left[left <= right], right[left <= right]
        if len(left):
            stack.append((depth_now + 1, left, right))
    return singles, wholes


def _unit(block: pd.DataFrame) -> np.ndarray:
    vectors = np.stack([np.asarray(v, np.float64) for v in block["vector"]])
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _upper(block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """From the sample of a dimension its centres that enough vectors are near to: (dimension, members, vector)."""

    def centres(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class", ignore_index=True)
        vectors = _unit(rows)
        places, members = np.unique(owners(vectors, NEAR)[-1], return_counts=True)
        enough = (members >= LEAST_SAMPLED) & (members / len(rows) * rows["n"].iloc[0] >= LEAST_PART * block)
        found = vectors[places[enough]]
        return pd.DataFrame({"dimension": rows["dimension"].iloc[:1].repeat(len(found)).to_numpy(), "members": members[enough], "vector": pd.Series(list(found), dtype=object)})

    return centres


def _nearest(centres: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Add the nearest centre of a row's dimension, and the distance from it; -1 and 2 if none is near."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            centre, reach = np.full(len(batch), -1, np.int32), np.full(len(batch), 2.0)
            for dimension, (numbers, vectors) in centres.items():
                of = np.flatnonzero(batch["dimension"].to_numpy() == dimension)
                for at in range(0, len(of), 1024):
                    some = of[at : at + 1024]
                    cosine = _unit(batch.iloc[some]) @ vectors.T
                    best = cosine.argmax(1)
                    gap = np.sqrt(np.maximum(0, 2 - 2 * cosine[np.arange(len(some)), best]))
                    centre[some] = np.where(gap <= NEAR, numbers[best], -1)
                    reach[some] = np.where(gap <= NEAR, gap, 2.0)
            yield batch.assign(centre=centre, reach=reach)

    return near


def _partners(groups: list[Row], centres: dict[int, tuple[np.ndarray, np.ndarray]], far: float) -> list[tuple[int, int, int, int]]:
    """(dimension, centre, other, blocks of the other) of all centres near enough for vectors below them to be linked."""
    found = []
    for dimension, (numbers, vectors) in centres.items():
        of = {g["centre"]: g for g in groups if g["dimension"] == dimension}
        here = [(i, of[n]) for i, n in enumerate(numbers.tolist()) if n in of]
        places = np.array([i for i, _ in here], np.int64)
        reach = np.array([g["reach"] for _, g in here])
        gap = np.sqrt(np.maximum(0, 2 - 2 * vectors[places] @ vectors[places].T))
        for a, b in np.argwhere(gap <= far + reach[:, None] + reach[None, :] + 1e-6).tolist():
            found.append((dimension, here[a][1]["centre"], here[b][1]["centre"], here[b][1]["blocks"]))
    return found


def _key() -> Column:
    """The name of a centre, or of the vectors of a dimension without one."""
    return F.concat_ws(":", "dimension", "centre").alias("key")


def _number(centre: Column, below: Column) -> Column:
    return (centre.cast("bigint") + 1) * F.lit(_BELOW) + below


def deal(classes: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """classes (class, dimension, weight, vector) with key and block; and for each key the keys that it meets.

    The second table has key and met, an array of structs (other centre, its number of blocks), which names the own one too.
    """
    spark = classes.sparkSession
    sizes = materialise(classes.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")), "dimensions")
    large = sizes.where(F.col("n") >= 2 * block)
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    sampled = lookup_join(classes, large, "dimension", "inner", ["class"]).where(F.pmod(F.xxhash64("class", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30))
    upper = sampled.select("dimension", "class", "vector", "n").groupBy("dimension").applyInPandas(
        _upper(block), "dimension int, members bigint, vector array<double>"
    )
    chosen = upper.orderBy(F.desc("members"), "dimension", "vector").limit(CENTRES).collect()
    centres = {
        d: (np.array([i for i, r in enumerate(chosen) if r["dimension"] == d], np.int64), np.array([r["vector"] for r in chosen if r["dimension"] == d]))
        for d in {r["dimension"] for r in chosen}
    }
    columns = ["dimension", "class", "weight", "vector"]
    rows = classes.select(*columns)
    if not centres:
        placed = rows.withColumns({"centre": F.lit(-1), "reach": F.lit(2.0)})
    else:
        schema = "dimension int, class bigint, weight bigint, vector array<double>, centre int, reach double"
        placed = materialise(rows.mapInPandas(_nearest(centres), schema), "placed")
    groups = placed.groupBy("dimension", "centre").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.max("reach").alias("reach"))
    groups = materialise(groups, "groups")
    # Blocks without a centre meet all of their dimension.
    known = groups.where("centre >= 0")
    free = groups.where("centre < 0").select("dimension", F.lit(-1).alias("other"), "blocks")
    meet = groups.where("centre < 0").select("dimension", "centre").join(groups.select("dimension", F.col("centre").alias("other"), "blocks"), "dimension")
    meet = meet.unionByName(known.select("dimension", "centre").join(free, "dimension"))
    near = _partners(known.collect(), centres, math.sqrt(max(0.0, 2 - 2 * threshold)))
    meet = meet.unionByName(spark.createDataFrame(near, "dimension int, centre int, other int, blocks bigint"))
    ways = meet.groupBy(_key()).agg(F.collect_list(F.struct("other", "blocks")).alias("met"))
    numbered = lookup_join(placed.withColumn("key", _key()), groups.select(_key(), "blocks"), "key", "inner", ["class"])
    block_of = _number(F.col("centre"), F.pmod(F.xxhash64("class"), F.col("blocks"))).alias("block")
    return numbered.select(*columns, "key", block_of), materialise(ways, "ways")


def meetings(dealt: DataFrame, ways: DataFrame) -> DataFrame:
    """Each row of dealt once for each block that its block meets (other)."""
    below = F.transform("met", lambda m: F.transform(F.sequence(F.lit(0).cast("bigint"), m["blocks"] - 1), lambda i: _number(m["other"], i)))
    found = lookup_join(dealt, ways, "key", "inner", ["class"])
    return found.select(*(c for c in dealt.columns if c != "key"), F.explode(F.flatten(below)).alias("other"))


def _planted(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block with the owners that make it a cover tree, as places in the order of class."""
    rows = rows.sort_values("class", ignore_index=True)
    return rows.assign(owners=list(owners(_unit(rows)).T.astype(np.int32)))


def _compared(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(class, n_links, linked): of the vectors of a pair of blocks, or of one block with itself."""
    blocks = [block.sort_values("class", ignore_index=True) for _, block in rows.groupby("block", sort=True)]
    same = bool(rows["alone"].iloc[0])
    if not same and len(blocks) < 2:
        return pd.DataFrame({"class": [], "n_links": [], "linked": []})
    trees = [Tree(_unit(b), np.stack(b["owners"].to_list()).T.astype(np.int64)) for b in blocks]
    one, two = trees[0], trees[-1]
    singles, wholes = traverse(one, two, threshold, same)
    names = [b["class"].to_numpy()[t.order] for b, t in zip(blocks, trees, strict=True)]
    weights = [b["weight"].to_numpy()[t.order] for b, t in zip(blocks, trees, strict=True)]
    shift = 0 if same else len(names[0])
    all_names = names[0] if same else np.concatenate(names)
    all_weights = weights[0] if same else np.concatenate(weights)
    links, union = np.zeros(len(all_names), np.int64), _Union(len(all_names))
    for i, j in singles:
        np.add.at(links, i, all_weights[j + shift])
        np.add.at(links, j + shift, all_weights[i])
        for x, y in zip(i.tolist(), (j + shift).tolist(), strict=True):
            union.join(x, y)
    for b1, e1, b2, e2 in wholes:
        b2, e2 = b2 + shift, e2 + shift
        links[b1:e1] += all_weights[b2:e2].sum()
        links[b2:e2] += all_weights[b1:e1].sum()
        for y in range(b2, e2):
            union.join(int(b1), y)
        for x in range(b1 + 1, e1):
            union.join(x, int(b2))
    roots = np.array([union.root(i) for i in range(len(all_names))], np.int64)
    found = np.flatnonzero(links)
    return pd.DataFrame({"class": all_names[found], "n_links": links[found], "linked": all_names[roots[found]]})


def _comparer(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _compared(rows, threshold)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row for each row of vectors (id, vector): id, n_links, component_id."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    of = F.col("vector").cast("array<double>")
    bad = F.exists(of, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = vectors.select("id", of.alias("vector"), F.monotonically_increasing_id().alias("row"))
    sound = F.coalesce(~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    # Equal vectors are one class, so a large group of copies is one vector in the trees.
    rows = materialise(rows.select("id", "row", F.when(sound, F.col("vector")).alias("vector")), "vectors")
    classes = rows.where("vector is not null").groupBy("vector").agg(
        F.count(F.lit(1)).alias("weight"), F.min("row").alias("class"), F.min("id").alias("smallest")
    )
    classes = materialise(classes.withColumn("dimension", F.size("vector")), "classes")
    columns = "dimension int, class bigint, weight bigint, vector array<double>, key string, block bigint"
    # Each block becomes a tree once.
    dealt, ways = deal(classes, threshold, block)
    dealt = dealt.groupBy("dimension", "block").applyInPandas(_planted, columns + ", owners array<int>")
    dealt = materialise(dealt, "trees")
    # A block meets itself and each other one once: the pair is named by both numbers.
    met = meetings(dealt, ways).select(
        "dimension",
        "block",
        "class",
        "weight",
        "vector",
        "owners",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") == F.col("other")).alias("alone"),
    )
    compared = met.groupBy("dimension", "low", "high").applyInPandas(
        _comparer(threshold), "class bigint, n_links bigint, linked bigint"
    )
    compared = materialise(compared, "compared")
    counts = compared.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    labels = components(compared, "class", "linked").withColumnRenamed("node", "class")
    classes = classes.select("class", "vector", "weight", "smallest").join(counts, "class", "left").join(labels, "class", "left")
    classes = classes.withColumn("component", F.coalesce("component", "class"))
    smallest = classes.groupBy("component").agg(F.min("smallest").alias("component_id"))
    classes = classes.join(smallest, "component").select(
        "vector", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    return rows.join(classes, "vector", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
