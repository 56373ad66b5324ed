"""Quality of documents by pairwise ranking: a Bradley-Terry model of which of two documents is preferred.

A document has a score s, linear in its features, and is preferred to another with
the probability of the logistic function of the difference of their scores. The weights
are learned from all pairs of a labelled good and a labelled bad document by the logistic
loss on the differences of their features. A document is kept if its score is at
least the quantile of the scores of all labelled documents at the share of bad labels. The score that is returned
is the probability of being preferred to a document at that quantile, shifted so that
the quantile itself has the value of the parameter ``cut``.

Features say how a text is written, not what it says: the shares of all pairs of
neighbouring character classes (letters, capitals, digits, blanks, line ends, each
punctuation mark, bytes of other letters), the share of words and of lines that are
repeated, and the mean length of words and lines. They are made in one pass over
the bytes of whole texts.

All labelled documents take part. Their features are written once, and each step reads
them where they are. How strongly the pairs of a document pull at it depends on its score
and on how the scores of the other label are spread; so a step counts the scores of
both labels on a fine grid, and then sums the pulls. Only these counts and one number for
each feature reach the driver, however many documents there are. Sums over tasks are
of whole numbers, so their order does not change a score.

Defined cases. Null and empty texts have all features 0. Labels that are null, and labels
without a document, are not learned from. Without documents of both labels every
score is the share of label 1, or 0 if there are no labels. Repeated rows are
scored one by one; in training each row counts once for each label of its doc_id, repeated
labels included. Ties at the quantile are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, ShortType, StructField, StructType

from tuneprep.llm.words import Words, byte_class, lists, slices, text_bytes
from tuneprep.operators.joins import fits_broadcast, salted_join
from tuneprep.session import materialise

# Steps over all pairs end when one lowers the loss by less than this part, and after MOST_STEPS; MEMORY steps shape the next one.
SETTLED, MOST_STEPS, MEMORY = 1e-3, 40, 10
# Scores in training: the width of the grid that they are counted on, and how far from their mean they are told apart.
GRID, LIMIT = 1 / 64, 1024
# Parts into which the scores around a rank are dealt until one value is left.
RANK_BINS = 4096
# Preference pairs drawn from rows in memory, and steps of their descent.
PAIRS = 60_000
STEPS = 300
RATE = 0.05
# Weight of the sum of squares of the weights.
RIDGE = 1e-4
# The score at the quantile.
CUT = 0.3
# Bytes of text looked at together, and rows.
PIECE, ROWS = 2 << 20, 256

_PUNCTUATION = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]


def _classes() -> np.ndarray:
    """The class of each byte."""
    out = np.zeros(256, np.int64)
    out[[0x20, 0x09]] = 1
    out[[0x0A, 0x0D]] = 2
    out[0x30:0x3A] = 3
    out[0x41:0x5B] = 4
    out[0x61:0x7B] = 5
    out[0x80:0xC0] = 6
    out[0xC0:] = 7
    out[_PUNCTUATION] = 8 + np.arange(len(_PUNCTUATION))
    return out


CLASS = _classes()
KINDS = int(CLASS.max()) + 1
# Pairs of classes, then: repeated words, repeated lines, length of words, length of lines, length of the text.
FEATURES = KINDS * KINDS + 5

_word = Words(~byte_class((0x20, 0x20), (0x09, 0x0D)))
_line = Words(~byte_class((0x0A, 0x0A), (0x0D, 0x0D)))


def _repeated(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The share of the hashes of each row that stand earlier in the row."""
    counts = np.diff(offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    again = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    return np.bincount(row[1:][again], minlength=len(counts)) / np.maximum(counts, 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    length = np.diff(offsets)
    kind = CLASS[data]
    row = np.repeat(np.arange(rows), length)
    inside = row[1:] == row[:-1]
    pair = (row[1:] * KINDS + kind[:-1]) * KINDS + kind[1:]
    pairs = np.bincount(pair[inside], minlength=rows * KINDS * KINDS).reshape(rows, KINDS * KINDS)
    out = np.zeros((rows, FEATURES), np.float32)
    # Roots of shares: rare pairs count, and frequent ones don't drown them.
    out[:, : KINDS * KINDS] = np.sqrt(pairs / np.maximum(length - 1, 1)[:, None])
    for i, cut in enumerate((_word, _line)):
        hashes, at = cut(column)
        out[:, KINDS * KINDS + i] = _repeated(hashes, at)
        out[:, KINDS * KINDS + 2 + i] = np.log1p(length / np.maximum(np.diff(at), 1))
    out[:, -1] = np.log1p(length)
    return out


@dataclass
class Model:
    """weight for each feature; the score of a text is their product, less the quantile, plus the logit of the cut."""

    weight: np.ndarray
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.offset, -50, 50)))


def pair_loss(weight: np.ndarray, x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """The mean logistic loss of the pairs (rows of x) with the ridge term, and its gradient."""
    scores = x @ weight.astype(x.dtype, copy=False)
    margin = scores[better] - scores[worse]
    loss = np.logaddexp(0, -margin).mean() + ridge * weight @ weight
    # Each pair pulls its two documents apart; what meets at a document is summed before the features are touched.
    pull = -1 / (1 + np.exp(np.clip(margin, -50, 50))) / len(margin)
    by_row = np.bincount(better, pull, len(x)) - np.bincount(worse, pull, len(x))
    return float(loss), x.T @ by_row.astype(x.dtype, copy=False) + 2 * ridge * weight


def train(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, cut: float = CUT, pairs: int = PAIRS, seed: int = 13) -> Model:
    """Fit weights on drawn preference pairs of rows in memory; the quantile is that of the weighted rows at the share of label 0.

    What ``fit`` does over all pairs, for features that a caller has as one small array.
    """
    rng = np.random.default_rng(seed)
    better, worse = (rng.choice(np.flatnonzero(labels == y), pairs) for y in (1, 0))
    spread = x.std(axis=0, dtype=np.float64)
    used = np.flatnonzero(spread > 1e-6)
    scale = 1 / spread[used]
    z = ((x[:, used] - x[:, used].mean(axis=0, dtype=np.float64)) * scale).astype(np.float32)
    weight = np.zeros(len(used))
    m, v = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, STEPS + 1):
        _, g = pair_loss(weight, z, better, worse)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        weight -= RATE * (1 - (step - 1) / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    weight, short = np.zeros(x.shape[1]), weight
    weight[used] = short * scale
    scores = x @ weight
    order = np.argsort(scores, kind="stable")
    below = np.cumsum(weights[order])
    at = int(np.searchsorted(below, weights[labels == 0].sum() * (1 - 1e-9)))
    # Half-way to the next score: the last row below the quantile has the share of label 0 behind it.
    quantile = (scores[order[at]] + scores[order[min(at + 1, len(order) - 1)]]) / 2
    return Model(weight, float(np.log(cut / (1 - cut)) - quantile))


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, len(whole), ROWS):
            yield from slices(whole.slice(start, ROWS), text, PIECE)


def _sparse(rows: DataFrame) -> DataFrame:
    """rows with place and value, the features of text that are not 0, in its stead: most pairs of classes are in no text."""
    kept = [c for c in rows.columns if c != "text"]
    rows = rows.select(*kept, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, len(kept)):
            x = features(batch.column(len(kept)))
            row, place = np.nonzero(x)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])
            found = [lists(place, offsets, pa.int16()), lists(x[row, place], offsets, pa.float32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*kept, "place", "value"])

    added = [StructField("place", ArrayType(ShortType())), StructField("value", ArrayType(FloatType()))]
    return rows.mapInArrow(work, StructType([*rows.schema.fields[:-1], *added]))


def _learned(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, bad, place, value) of all labelled documents: how many labels of each kind, and features."""
    count = lambda y: F.count(F.when(F.col("label") == y, True))
    known = labels.groupBy("id").agg(count(1).alias("good"), count(0).alias("bad"))
    texts = documents.where("id is not null and text is not null").select("id", "text")
    if fits_broadcast(known):
        rows = _sparse(texts.join(F.broadcast(known), "id").drop("id"))
    else:
        # Features are shorter than texts, and so are what is shuffled.
        keyed = texts.withColumn("key", F.xxhash64("id", "text"))
        rows = salted_join(_sparse(keyed), known, "id", "inner", ["key"])
    return materialise(rows.select("good", "bad", "place", "value"), "features")


# Of a batch of documents: labels 1 and 0 of each, the row, place and value of each feature that is not 0.
Work = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
    place, value = (pc.list_flatten(batch.column(i)).to_numpy(zero_copy_only=False) for i in (2, 3))
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), row, place, value.astype(np.float64)


def _sums(rows: DataFrame, work: Work, size: int) -> np.ndarray:
    """The sum of the arrays of this size that work gives for the batches of rows. Tasks are added in whole numbers of 2**-40."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += work(*_flat(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "part"])

    whole = F.rint(F.col("part") * 2.0**40).cast("decimal(28,0)")
    parts = rows.mapInArrow(task, "at bigint, part double").groupBy("at").agg(F.sum(whole).alias("part"))
    out = np.zeros(size)
    for r in parts.collect():
        out[r["at"]] = float(r["part"]) / 2.0**40
    return out


def _on_grid(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place on the grid of each score, and how far it lies towards the next one."""
    at = (np.clip(scores, -LIMIT, LIMIT - GRID) + LIMIT) / GRID
    low = at.astype(np.int64)
    return low, at - low


GRID_SIZE = int(2 * LIMIT / GRID) + 1


def _spread(scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights of scores on the grid, each dealt to the two places next to it."""
    low, part = _on_grid(scores)
    return np.bincount(low, weights * (1 - part), GRID_SIZE) + np.bincount(low + 1, weights * part, GRID_SIZE)


def pulls(good: np.ndarray, bad: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss of all pairs of a good and a bad document, by the weights of their scores on the grid, and how strongly a good
    and a bad document at each place is pulled up and down."""
    inside = np.flatnonzero(good + bad)
    begin, end = inside[0], inside[-1] + 1
    n = end - begin
    apart = np.arange(-(n - 1), n) * GRID
    size = 1 << int(3 * n).bit_length()

    def against(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        """The sum of counts[m] * kernel(k - m) for each place k."""
        return np.fft.irfft(np.fft.rfft(counts[begin:end], size) * np.fft.rfft(kernel, size), size)[n - 1 : 2 * n - 1]

    lower = 1 / (1 + np.exp(np.clip(apart, -50, 50)))
    up, down = np.zeros(GRID_SIZE), np.zeros(GRID_SIZE)
    up[begin:end] = np.maximum(0, against(bad, lower))
    down[begin:end] = np.maximum(0, against(good, lower[::-1]))
    return float(good[begin:end] @ against(bad, np.logaddexp(0, -apart))), up, down


def _direction(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Where to go next, by the gradient and the last steps (change of weights, change of gradient): limited-memory BFGS."""
    q, shares = gradient.copy(), []
    for s, y in reversed(steps):
        shares.append(s @ q / (s @ y))
        q -= shares[-1] * y
    if steps:
        s, y = steps[-1]
        q *= s @ y / (y @ y)
    for (s, y), share in zip(steps, reversed(shares), strict=True):
        q += s * (share - y @ q / (s @ y))
    return -q


def _all_pairs(rows: DataFrame, good: int, bad: int) -> np.ndarray:
    """The weights that minimise the mean loss over all pairs of the rows with the ridge term on scaled weights."""

    def moments(g: np.ndarray, b: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        times = (g + b)[row] * value
        return np.concatenate([np.bincount(place, w, FEATURES) for w in (times, times * value)])

    first, second = _sums(rows, moments, 2 * FEATURES).reshape(2, FEATURES) / (good + bad)
    deviation = np.sqrt(np.maximum(0, second - first**2))
    used = deviation > 1e-6
    scale = np.where(used, 1 / np.where(used, deviation, 1), 0)

    def scored(weight: np.ndarray) -> Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        by_place, middle = weight * scale, first @ (weight * scale)
        return lambda n, row, place, value: np.bincount(row, by_place[place] * value, n) - middle

    def loss(weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        score = scored(weight)

        def grid(g: np.ndarray, b: np.ndarray, *x: np.ndarray) -> np.ndarray:
            s = score(len(g), *x)
            return np.concatenate([_spread(s, g), _spread(s, b)])

        total, up, down = pulls(*_sums(rows, grid, 2 * GRID_SIZE).reshape(2, GRID_SIZE))
        return total / good / bad + RIDGE * weight @ weight, up, down

    def gradient(weight: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        score = scored(weight)
        seen = np.flatnonzero(up + down)
        if not len(seen):
            return 2 * RIDGE * weight
        # Only the part of the grid that pulls is sent.
        begin, up, down = seen[0], up[seen[0] : seen[-1] + 1] / bad, down[seen[0] : seen[-1] + 1] / good

        def pulled(g: np.ndarray, b: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
            low, part = _on_grid(score(len(g), row, place, value))
            low, high = (np.clip(i - begin, 0, len(up) - 1) for i in (low, low + 1))
            at = lambda pull: pull[low] * (1 - part) + pull[high] * part
            return np.concatenate([np.bincount(place, w[row] * value, FEATURES) for w in (b * at(down), g * at(up))])

        fall, rise = _sums(rows, pulled, 2 * FEATURES).reshape(2, FEATURES)
        return (fall / bad - rise / good) * scale + 2 * RIDGE * weight

    weight, steps = np.zeros(FEATURES), []
    now, up, down = loss(weight)
    slope = gradient(weight, up, down)
    for _ in range(MOST_STEPS):
        way = _direction(slope, steps)
        if way @ slope >= 0:
            steps, way = [], -slope
        length = 1.0 if steps else 1 / max(np.sqrt(way @ way), 1e-12)
        for _ in range(20):
            then, up, down = loss(weight + length * way)
            if then <= now + 1e-4 * length * (way @ slope):
                break
            length /= 2
        else:
            break
        before, weight = slope, weight + length * way
        slope = gradient(weight, up, down)
        if length * way @ (slope - before) > 0:
            steps = [*steps, (length * way, slope - before)][-MEMORY:]
        now, last = then, now
        if last - now < SETTLED * last:
            break
    return weight * scale


def at_rank(scored: DataFrame, rank: int) -> float:
    """The score with this place, from 1 on, in the order of all rows (score, times), each of which counts ``times`` times.

    Only counts and bounds of RANK_BINS parts reach the driver.
    """
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    before = 0
    while low < high:
        place = F.least(F.floor((F.col("score") - low) / ((high - low) / RANK_BINS)), F.lit(RANK_BINS - 1))
        inside = scored.where(F.col("score").between(low, high)).groupBy(place.alias("place"))
        for r in sorted(inside.agg(F.sum("times").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()):
            low, high = r["low"], r["high"]
            if before + r["n"] >= rank:
                break
            before += r["n"]
    return low


def fit(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> Model:
    """A model learned from all labelled documents, and the quantile of all their scores.

    documents: id, text; labels: id, label (0 or 1).
    """
    labels = labels.where("id is not null and label in (0, 1)").select("id", "label")
    rows = _learned(documents, labels)
    good, bad = rows.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not good or not bad:
        share = labels.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        return Model(np.zeros(FEATURES), float(np.log((share + 1e-12) / (1 - share + 1e-12))))
    weight = _all_pairs(rows, good, bad)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, b, row, place, value = _flat(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.bincount(row, weight[place] * value, len(g))), pa.array(g + b)], ["score", "times"])

    scored = materialise(rows.mapInArrow(work, "score double, times bigint"), "scores")
    # Half-way to the next score: the last row below the quantile has the share of label 0 behind it.
    last, following = at_rank(scored, bad), at_rank(scored, bad + 1)
    quantile = (last + following) / 2 if following > last else last - 1e-9
    return Model(weight, float(np.log(cut / (1 - cut)) - quantile))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows with score, which replaces a column of that name; rows has a column text."""
    rows = rows.drop("score")
    text = rows.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, text):
            scores = model.score(features(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
