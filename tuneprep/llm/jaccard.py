"""Jaccard join of documents on word n-grams: rare-first prefix filtering.

A document's set is its distinct n-word shingles, as 64-bit hashes. Two sets whose
similarity reaches the threshold share a token among the first
``size - ceil(t * size) + 1`` of each in any common order; rarest first keeps the
lists of documents per token short. Equal sets are one class from the start, named
by a 64-bit hash of the set. Pairs that share a prefix token pass the length,
positional and suffix filters, once each, and are then verified on the whole sets.

Only the components of the links are wanted, so a long list of documents of one token
is not expanded into all its pairs: every class is compared with one leader of the
list, and what is linked becomes one component. After some rounds the list is dealt
into blocks, and the filters pick the pairs of two blocks that lie in different
components. No link between two components is lost, and a large group of near
copies costs a few comparisons for each member.

Defined cases. Null, empty and wordless texts have an empty set, are linked with
nothing and are their own component. Texts of fewer words than a shingle have one
token, the whole sequence. Repeated rows get one row each. A null id is no candidate
for the smallest id of its component; a component of null ids alone has a null id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tuneprep.llm.components import components
from tuneprep.llm.words import Words, byte_class, lists, mix, shingles, slices
from tuneprep.operators.bit_filter import bit_filter, may_match
from tuneprep.operators.joins import fits_broadcast
from tuneprep.session import materialise

NGRAM = 3
PERCENT = 90
# Counters of the frequency sketch, a fixed size whatever the input; it is summed in SLICES parts.
COUNTERS = 1 << 18
SLICES = 16
# Parts of the suffix filter.
PARTS = 256
# A token counts as heavy if its counter has that many times the mean; heavy tokens are not counted exactly.
HEAVY = 4
# Lists longer than LONG are compared with leaders first, as long as they have more open pairs than OPEN times the
# postings; what remains after these rounds is compared in blocks of about BLOCK sets, however much it is.
LONG = 48
OPEN = 1
LEADER_ROUNDS = 4
# Rounds end when one closes less than this part of the open pairs.
CLOSED = 0.5
BLOCK = 512

WORD_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def smallest_linked(percent: int) -> int:
    """The smallest size of a set that can be linked with a different set."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def _sets(batch: pa.RecordBatch, n: int, cut: Words) -> list[np.ndarray]:
    """The sorted distinct shingles of each row."""
    hashes, offsets = cut(batch.column(1))
    grams = shingles(hashes, n)
    out = []
    for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
        whole = grams[begin : end - n + 1] if end - begin >= n else shingles(hashes[begin:end], max(1, end - begin))
        out.append(np.unique(whole))
    return out


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(sizes)])


def _names(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order of its members."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat))])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _profiled(batches: Iterator[pa.RecordBatch], n: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row (id, size, set) for each text, and last the slices of the sketch of this task's shingles."""
    names = ["id", "size", "set", "slice", "counts"]
    cut, sketch = Words(WORD_BYTES), np.zeros(COUNTERS, np.int64)
    for whole in batches:
        for batch in slices(whole, 1):
            flat, offsets = _flat(_sets(batch, n, cut))
            sketch += np.bincount((flat & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            sizes, none = np.diff(offsets), pa.nulls(len(batch), pa.int32())
            sets = pa.array(_names(flat, offsets), pa.int64(), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), sets, none, pa.nulls(len(batch), pa.binary())], names)
    parts = [x.tobytes() for x in sketch.reshape(SLICES, -1)]
    none = pa.nulls(SLICES, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(SLICES, kind), none, none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the counts of each slice among the rows of a task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(counts.as_buffer(), np.int64)
            total[part] = total[part] + counts if part in total else counts.copy()
    for part, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["slice", "counts"])


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counts as whole numbers of 24 bits, which keep the order of counts of any size."""
    return (np.log2(1.0 + counts) * (1 << 18)).astype(np.uint32)


def _sketch(profile: DataFrame) -> np.ndarray:
    """How many documents hold a shingle of each counter, over all documents, scaled: COUNTERS numbers whatever their count."""
    parts = profile.where("slice is not null").select("slice", "counts")
    parts = parts.repartition(SLICES, "slice").mapInArrow(_summed, "slice int, counts binary")
    sketch = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for row in parts.collect():
        sketch[row["slice"]] += np.frombuffer(row["counts"], np.int64)
    return _scaled(sketch.ravel())


def _prefixed(batches: Iterator[pa.RecordBatch], n: int, percent: int, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(set, size, tokens, heavy, parts) of the texts whose set is large enough: the prefix, which of its tokens are
    heavy by the sketch, and counts by part of the hash."""
    cut, least = Words(WORD_BYTES), smallest_linked(percent)
    heavy_from = _scaled(HEAVY * np.maximum(1, (2.0 ** (sketch / (1 << 18)) - 1).mean()))
    for whole in batches:
        for batch in slices(whole, 1):
            sets = [s for s in _sets(batch, n, cut) if len(s) >= least]
            if not sets:
                continue
            flat, offsets = _flat(sets)
            sizes = np.diff(offsets)
            prefix = sizes - -(-percent * sizes // 100) + 1
            # The order of tokens: how often their counter was hit, then their hash.
            key = (sketch[(flat & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (flat >> np.uint64(24))
            first = np.concatenate([b + np.argsort(key[b:e], kind="stable")[:p] for b, e, p in zip(offsets[:-1], offsets[1:], prefix, strict=True)])
            heavy = (key[first] >> np.uint64(40)) >= heavy_from
            row = np.repeat(np.arange(len(sets)), sizes)
            part = (flat >> np.uint64(64 - (PARTS - 1).bit_length())).astype(np.int64)
            counts = np.bincount(row * PARTS + part, minlength=len(sets) * PARTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_names(flat, offsets)),
                    pa.array(sizes),
                    lists(flat[first].view(np.int64), np.concatenate([[0], np.cumsum(prefix)])),
                    lists(heavy, np.concatenate([[0], np.cumsum(prefix)])),
                    lists(counts, np.arange(len(sets) + 1) * PARTS),
                ],
                ["set", "size", "tokens", "heavy", "parts"],
            )


def _whole(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(set, members) of texts."""
    cut = Words(WORD_BYTES)
    for whole in batches:
        for batch in slices(whole, 1):
            flat, offsets = _flat(_sets(batch, n, cut))
            yield pa.RecordBatch.from_arrays([pa.array(_names(flat, offsets)), lists(flat.view(np.int64), offsets)], ["set", "members"])


def _needed(percent: int, a: str, b: str) -> Column:
    """How many members two sets of these sizes must share."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _bound(x: str = "x", y: str = "y") -> Column:
    """At most how many members two sets share that share a token at these places (positional filter)."""
    rest = F.least(F.col(f"{x}_size") - F.col(f"{x}_place"), F.col(f"{y}_size") - F.col(f"{y}_place"))
    return F.least(f"{x}_place", f"{y}_place") + rest


def _filtered(pairs: DataFrame, percent: int) -> DataFrame:
    """Length and positional filter of rows (x, y, x_size, y_size, x_place, y_place)."""
    return pairs.where(
        (F.least("x_size", "y_size") * 100 >= F.greatest("x_size", "y_size") * percent)
        & (_bound() >= _needed(percent, "x_size", "y_size"))
    )


def _block_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of the sets of two blocks of one token's list, or of one, that may be linked and lie in two components.

    Length filter; count filter: what two sets share lies in both prefixes, or beyond the
    end of the shorter-reaching one; suffix filter. A pair is given in the list of the
    smallest token that both prefixes have, so in one list only.
    """
    token, alone = rows["token"].iloc[0], bool(rows["alone"].iloc[0])
    low = rows["low"].iloc[0]
    names, sizes, comp = (rows[c].to_numpy() for c in ("set", "size", "component"))
    length = rows["tokens"].map(len).to_numpy()
    kinds, column, count = np.unique(np.concatenate(rows["tokens"].to_list()), return_inverse=True, return_counts=True)
    has = np.zeros((len(rows), int((count > 1).sum())), np.float32)
    place = np.cumsum(count > 1) - 1
    row, often = np.repeat(np.arange(len(rows)), length), count[column] > 1
    has[row[often], place[column[often]]] = 1
    wanted = np.flatnonzero(kinds[count > 1] == token)
    parts = np.stack(rows["parts"].to_list())
    beyond = sizes - length
    one = np.arange(len(rows)) if alone else np.flatnonzero(rows["block"].to_numpy() == low)
    two = one if alone else np.flatnonzero(rows["block"].to_numpy() != low)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(wanted) and len(two):
        earlier = has[:, : wanted[0]]
        for i in one:
            j = two[(comp[two] != comp[i]) & (100 * np.minimum(sizes[two], sizes[i]) >= percent * np.maximum(sizes[two], sizes[i]))]
            if alone:
                j = j[j > i]
            needed = -(-percent * (sizes[j] + sizes[i]) // (100 + percent))
            j = j[has[j] @ has[i] + np.maximum(beyond[j], beyond[i]) >= needed]
            j = j[earlier[j] @ earlier[i] == 0]
            needed = -(-percent * (sizes[j] + sizes[i]) // (100 + percent))
            j = j[np.minimum(parts[j], parts[i]).sum(1) >= needed]
            found.append((np.full(len(j), i), j))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    swap = names[i] > names[j]
    x, y = np.where(swap, j, i), np.where(swap, i, j)
    return pd.DataFrame({"x": names[x], "y": names[y], "x_size": sizes[x], "y_size": sizes[y]})


def _only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be a wanted one (distinct): others go where they are read, and are not shuffled in vain."""
    return rows.where(may_match(F.col(key), bit_filter(wanted, key, wanted.count())))


def _block_comparer(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _block_pairs(rows, percent)


class _Join:
    """The tables that the rounds share."""

    def __init__(self, documents: DataFrame, profile: DataFrame, prefixes: DataFrame, n: int, percent: int):
        self.documents, self.profile, self.prefixes, self.n, self.percent = documents, profile, prefixes, n, percent
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None
        # Rows with one id may have several texts, or one text several times.
        self.repeated = not profile.groupBy("id").count().where("count > 1 and id is not null").isEmpty()

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """(token, set, size, place, n) of the tokens that several sets have in their prefixes, in lists of n: short and long.

        Light tokens are counted where they are brought together, in the one shuffle of
        the prefixes; the sketch bounds how many rows one of them has. Heavy ones, few by
        definition and of any number of rows, are counted with partial sums. Size and place travel as one number.
        """
        both = F.col("size") * F.lit(1 << 31) + F.col("place")
        listed = self.prefixes.select("set", "size", F.posexplode(F.arrays_zip("tokens", "heavy")).alias("place", "t"))
        listed = listed.select(F.col("t.tokens").alias("token"), "set", both.alias("both"), F.col("t.heavy").alias("heavy"))
        light = listed.where("not heavy").drop("heavy").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("token"))).where("n > 1")
        heavy = materialise(listed.where("heavy").drop("heavy"), "heavy")
        counts = heavy.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = materialise(light.unionByName(heavy.join(counts, "token")), "postings")
        found = found.select("token", "set", F.shiftright("both", 31).alias("size"), (F.col("both") % F.lit(1 << 31)).alias("place"), "n")
        return found.where(F.col("n") <= LONG), found.where(F.col("n") > LONG)

    def members(self, wanted: DataFrame) -> DataFrame:
        """(set, members) of the wanted sets (column set), made of the text of one document for each.

        Texts are read where they are, and their sets are not written: they are long.
        """
        owners = materialise(self.profile.join(wanted, "set").groupBy("set").agg(F.min("id").alias("id")), "wanted")
        ids = owners.where("id is not null").select("id").distinct()
        ids = F.broadcast(ids) if fits_broadcast(ids) else ids
        texts = self.documents.join(ids, "id", "left_semi").select("id", "text")
        whole = lambda batches, n=self.n: _whole(batches, n)
        found = texts.mapInArrow(whole, "set bigint, members array<bigint>")
        found = found.dropDuplicates(["set"]) if self.repeated else found
        # Sets that only rows without an id have are looked for among all of these.
        lone = owners.where("id is null").select("set")
        if lone.isEmpty():
            return found
        nameless = self.documents.where("id is null").select("id", "text").mapInArrow(whole, "set bigint, members array<bigint>")
        nameless = nameless.join(F.broadcast(lone) if fits_broadcast(lone) else lone, "set", "left_semi")
        return found.unionByName(nameless.dropDuplicates(["set"]))

    def verify(self, pairs: DataFrame) -> None:
        """Test pairs (x, y, x_size, y_size), each once, that were not tested before, and keep the links."""
        pairs = pairs.dropDuplicates(["x", "y"])
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["x", "y"], "left_anti")
        pairs = materialise(pairs, "candidates")
        sets = pairs.select(F.col("x").alias("set")).unionByName(pairs.select(F.col("y").alias("set"))).distinct()
        parts = _only(self.prefixes.select("set", "parts"), sets, "set")
        pairs = pairs.join(parts.select(F.col("set").alias("x"), F.col("parts").alias("x_parts")), "x")
        pairs = pairs.join(parts.select(F.col("set").alias("y"), F.col("parts").alias("y_parts")), "y")
        most = F.aggregate(F.zip_with("x_parts", "y_parts", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
        pairs = pairs.withColumn("near", most >= _needed(self.percent, "x_size", "y_size"))
        pairs = materialise(pairs.select("x", "y", "x_size", "y_size", "near"), "pairs")
        tested = pairs.select("x", "y")
        self.tested = tested if self.tested is None else self.tested.unionByName(tested)
        near = pairs.where("near").drop("near")
        members = self.members(near.select(F.col("x").alias("set")).unionByName(near.select(F.col("y").alias("set"))).distinct())
        of = lambda side: members.select(F.col("set").alias(side), F.col("members").alias(f"{side}_members"))
        joined = near.join(of("x"), "x").join(of("y"), "y").withColumn("both", F.size(F.array_intersect("x_members", "y_members")))
        joined = joined.where(F.col("both") * 100 >= (F.col("x_size") + F.col("y_size") - F.col("both")) * self.percent)
        links = materialise(joined.select("x", "y"), "verified")
        self.links = links if self.links is None else self.links.unionByName(links)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with x before y, without places."""
    swap = F.col("x") > F.col("y")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return pairs.select(
        *(pick(f"x{end}", f"y{end}").alias(f"x{end}") for end in ("", "_size")),
        *(pick(f"y{end}", f"x{end}").alias(f"y{end}") for end in ("", "_size")),
    )


def _side(postings: DataFrame, x: str) -> DataFrame:
    kept = [c for c in ("size", "place", "component") if c in postings.columns]
    return postings.select("token", F.col("set").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in kept))


def _open(postings: DataFrame) -> DataFrame:
    """(token, main, n, n_main, pairs) of the lists that lie in several components: the one with most rows, the rows, and at
    most how many pairs of two components there are."""
    groups = postings.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    tokens = groups.groupBy("token").agg(
        F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main")
    )
    tokens = tokens.where("n > n_main").select("token", "main", "n", "n_main", ((F.col("n") - F.col("n_main")) * F.col("n")).alias("pairs"))
    return materialise(tokens, "open-lists")


def _with_leaders(postings: DataFrame, tokens: DataFrame, percent: int, round_: int) -> DataFrame:
    """Pairs of the leader of each open list and its rows of other components.

    The leader is the row with the smallest hash, of the main component if there is one of
    several rows: another one in each round, and mostly the same one in lists that hold
    mostly the same sets.
    """
    mixed = postings.join(tokens.select("token", "main", "n_main"), "token")
    lead = F.min_by(F.struct("set", "size", "place", "component"), F.struct(F.xxhash64("set", F.lit(round_)), "set")).alias("s")
    leaders = materialise(mixed.where("component = main or n_main = 1").groupBy("token").agg(lead).select("token", "s.*"), "leaders")
    pairs = _side(leaders, "x").join(_side(mixed, "y"), "token").where("x_component <> y_component")
    return _ordered(_filtered(pairs, percent))


def _in_blocks(postings: DataFrame, tokens: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, x_size, y_size) of the open lists. Each block meets itself and each other block of its list once."""
    blocks = F.ceil(F.col("n") / BLOCK)
    tokens = tokens.select("token", "n")
    rows = materialise(_only(postings.drop("n", "size", "place"), tokens, "token").join(tokens, "token"), "open-postings")
    rows = rows.join(_only(prefixes.select("set", "size", "tokens", "parts"), rows.select("set").distinct(), "set"), "set")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    met = rows.select(
        "token", "set", "size", "component", "tokens", "parts", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") == F.col("other")).alias("alone"),
    )
    return met.groupBy("token", "low", "high").applyInPandas(_block_comparer(percent), "x bigint, y bigint, x_size bigint, y_size bigint")


def _linked(join: _Join) -> DataFrame:
    """(node, component) of the sets that are linked with another set."""
    short, long = join.postings()
    allowed = (short.count() + long.count()) * OPEN
    long = long.withColumn("component", F.col("set"))
    tokens, before = _open(long), math.inf
    for round_ in range(LEADER_ROUNDS):
        pairs = tokens.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        if pairs <= allowed or pairs > (1 - CLOSED) * before:
            break
        before = pairs
        join.verify(_with_leaders(long, tokens, join.percent, round_))
        known = components(join.links, "x", "y").select(F.col("node").alias("set"), F.col("component").alias("known"))
        long = long.drop("component").join(known, "set", "left").withColumn("component", F.coalesce("known", "set")).drop("known")
        long = materialise(long, "long-postings")
        tokens = _open(long)
    pairs = _filtered(_side(short, "x").join(_side(short, "y"), "token").where("x < y"), join.percent)
    pairs = pairs.select("x", "y", "x_size", "y_size").unionByName(_in_blocks(long, tokens, join.prefixes, join.percent))
    join.verify(pairs)
    return components(join.links, "x", "y")


def similar(documents: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row for each row of documents (id, text): id, n_shingles, component_id.

    Documents are linked when 100 * intersection >= percent * union of their sets;
    component_id is the smallest id reachable by links.
    """
    documents = documents.select("id", "text")
    kind = documents.limit(0).toArrow().schema.field("id").type
    schema = f"id {documents.schema['id'].dataType.simpleString()}, size bigint, set bigint, slice int, counts binary"
    profile = materialise(documents.mapInArrow(lambda batches: _profiled(batches, n, kind), schema), "profile")
    sketch = _sketch(profile)
    rows = profile.where("slice is null").select("id", "size", "set")
    prefixes = documents.mapInArrow(
        lambda batches: _prefixed(batches, n, percent, sketch), "set bigint, size bigint, tokens array<bigint>, heavy array<boolean>, parts array<int>"
    )
    prefixes = prefixes.groupBy("set").agg(*(F.first(c).alias(c) for c in ("size", "tokens", "heavy", "parts")))
    prefixes = materialise(prefixes, "prefixes")
    labels = _linked(_Join(documents, rows, prefixes, n, percent))
    classes = rows.where("set is not null").groupBy("set").agg(F.min("id").alias("smallest"))
    classes = classes.join(labels.withColumnRenamed("node", "set"), "set", "left")
    classes = classes.withColumn("component", F.coalesce("component", "set"))
    smallest = classes.groupBy("component").agg(F.min("smallest").alias("component_id"))
    classes = classes.join(smallest, "component").select("set", "component_id")
    return rows.join(classes, "set", "left").select(
        "id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
