"""Toxicity by a bag of subwords: embeddings of character n-grams, averaged, into a linear softmax.

Words are the runs of letters and digits of the lower-cased text, with a mark at
either end; their character n-grams are hashed into buckets, and each bucket has a
vector. A document is the mean of its vectors. Vectors and the linear layer are
trained together. Unseen misspellings share most n-grams, and so most of their
vectors, with the words they come from.

As the layer is linear, a bucket's vector enters a score by its product with the
layer only: scoring sums one number for each n-gram of the whole text. The gradient of
the vectors, too, needs one number for each bucket only. So all labelled documents take
part: their bags are written once, dealt into batches by a hash of their id, and each step sends
the buckets' numbers to the bags of one batch and gets the sums of their pulls back. Only numbers
for each bucket reach the driver, no text and no bag. Tasks add whole numbers, so their order does not
change a score.

Defined cases. Null texts and texts without a word have the score of the bias alone,
that is of an empty bag. Labels that are null and labels without a document or text are not
learned from; in training each row counts once for each label of its id. Without rows of both labels every score is the share of label 1, or
0 if there are no labels. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tuneprep.llm.sampling import sample, within_bytes
from tuneprep.llm.words import mix, slices
from tuneprep.operators.bit_filter import bit_filter, may_match
from tuneprep.operators.joins import fits_broadcast, salted_join
from tuneprep.session import new_path

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSIONS = 8
# Means of many n-grams are small numbers; the layer works on this multiple of them.
SCALE = 100.0
# Labelled documents are dealt into batches of at least about so many of the rarer label, and into so many batches at most:
# each document takes part in a tenth of the steps or more.
PER_BATCH, MOST_BATCHES = 1000, 15
STEPS = 150
RATE = 0.05
# Weight of the sum of the absolute scores of buckets in the loss: n-grams that few documents share stay near 0.
SPARSITY = 3e-5
# A missed row of label 1 counts as much as that many rows of label 0 taken for it.
MISSED = 2.0
# A bucket takes part if so many of the documents that are learned from have it, however many there are.
LEAST_DOCUMENTS = 3
# When a bucket's score is that small a part of the largest after half of the steps, it is 0 from then on, and the rest
# is fitted without the sparsity term, which would leave scores too close to the mean.
NEGLIGIBLE = 0.02
# Characters of text looked at together.
PIECE = 1 << 17
# Entries of bags looked at together, and sums in a row that tasks send on.
ENTRIES, SUMS = 1 << 18, 1 << 12
# Pulls are added in whole numbers of this part.
UNIT = float(1 << 28)

_MARK = np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The marked words of all texts as code points with one mark between words, and where each text begins and the last ends."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    # Each text gets a mark of its own at both ends.
    lengths = np.array([len(t) for t in lowered], np.int64)
    padded = np.ones(len(codes) + 2 * len(texts), np.uint32)
    ends = np.cumsum(lengths + 2)
    text = np.repeat(np.arange(len(texts)), lengths)
    padded[np.arange(len(codes)) + 2 * text + 1] = codes
    word = ((padded >= 0x30) & (padded <= 0x39)) | ((padded >= 0x61) & (padded <= 0x7A)) | (padded >= 0xC0) & (padded != 0xD7) & (padded != 0xF7)
    word &= (padded < 0x2000) | (padded > 0x206F)
    keep = word.copy()
    keep[1:] |= ~word[1:] & word[:-1]
    begin = np.concatenate([[0], ends[:-1]])
    keep[begin] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    kept = np.where(word, padded, 1)[keep].astype(np.uint64)
    return kept, np.append(before[begin], before[-1])


def _grams(texts: list[str], sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size, from 3 on, the buckets of the n-grams at all places, which places begin one, and where each text begins and the last ends."""
    codes, offsets = _codes(texts)
    mark = codes == _MARK
    h = codes.copy()
    marks_inside = np.zeros(len(codes), bool)  # a mark between the first and the last place
    for n in range(2, max(sizes) + 1):
        count = len(codes) - n + 1
        if count <= 0:
            return
        h = h[:count] * _FACTOR + codes[n - 1 :]
        marks_inside = marks_inside[:count] if n == 2 else marks_inside[:count] | mark[n - 2 : n - 2 + count]
        if n in sizes:
            # From one text into the next there are two marks, one of them inside.
            good = ~marks_inside
            yield (mix(h + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int64), good, offsets


def counts(texts: list[str], sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, times): how many n-grams of a text fall into each bucket, by row, then bucket."""
    both = [np.zeros(0, np.int64)]
    for at, good, offsets in _grams(texts, sizes, buckets):
        row = np.repeat(np.arange(len(texts)) * buckets, np.diff(offsets))
        both.append((row[: len(at)] + at)[good])
    # Short numbers are sorted faster.
    both = np.sort(np.concatenate(both).astype(np.uint32 if len(texts) * buckets < 1 << 32 else np.uint64)).astype(np.int64)
    first = np.flatnonzero(np.diff(both, prepend=-1))
    return both[first] // buckets, both[first] % buckets, np.diff(first, append=len(both))


def bags(texts: list[str], sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, share): the share of each bucket among the n-grams of a text."""
    row, bucket, times = counts(texts, sizes, buckets)
    return row, bucket, times / np.bincount(row, weights=times)[row] if len(row) else times.astype(float)


def sums(texts: list[str], weight: np.ndarray, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """The mean weight of the n-grams of each text; 0 for a text without any."""
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    for at, good, offsets in _grams(texts, sizes, len(weight)):
        ends = np.minimum(offsets, len(at))
        some, begins = np.diff(ends) > 0, _begins(ends)
        total[some] += np.add.reduceat(weight[at] * good, begins, dtype=np.float64)
        number[some] += np.add.reduceat(good, begins, dtype=np.int64)
    return total / np.maximum(number, 1)


@dataclass
class Model:
    """vectors: (buckets, d); layer: (d, 2); bias: (2). weight is what scoring needs of them."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        return (SCALE * self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _sample_bags(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bags of all texts, compact, a few texts at a time; only of buckets that enough texts have."""
    parts = []
    for start in range(0, len(texts), 100):
        row, bucket, share = bags(texts[start : start + 100], buckets=buckets)
        parts.append(((row + start).astype(np.int32), bucket.astype(np.int32), (share * SCALE).astype(np.float32)))
    spread = sum(np.bincount(p[1], minlength=buckets) for p in parts)
    often = spread >= LEAST_DOCUMENTS
    return tuple(np.concatenate([p[i][often[p[1]]] for p in parts]) for i in range(3))


# (scores of the buckets, offset) to the gradient of the buckets' scores and that of the offset.
Pull = Callable[[np.ndarray, float], tuple[np.ndarray, float]]


def _descend(used: np.ndarray, pull: Pull, narrow: Callable[[np.ndarray], Pull], steps: int, seed: int) -> Model:
    """Fit vectors and layer together by Adam on the weighted cross-entropy and the sparsity term.

    used: which buckets take part. After half of the steps ``narrow`` gets the numbers of those that stay, and gives the
    gradient of these alone.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((len(used), DIMENSIONS)) * 1e-3).astype(np.float32)
    layer = rng.standard_normal((DIMENSIONS, 2)).astype(np.float32) / 2
    bias = np.zeros(2, np.float32)
    vectors[~used] = 0
    whole, stay = np.zeros_like(vectors), np.arange(len(used))
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (vectors, layer, bias)]
    for step in range(1, steps + 1):
        difference = layer[:, 1] - layer[:, 0]
        scores = vectors @ difference
        if step == steps // 2:
            stay = np.flatnonzero(used & (np.abs(scores) >= NEGLIGIBLE * np.abs(scores).max()))
            vectors, scores, used = vectors[stay], scores[stay], used[stay]
            state[0] = [s[stay] for s in state[0]]
            pull = narrow(stay)
        g, wrong = pull(scores, float(bias[1] - bias[0]))
        g = np.where(used, g + (SPARSITY if 2 * step < steps else 0) * np.sign(scores), 0).astype(np.float32)
        towards = vectors.T @ g
        found = (np.outer(g, difference), np.stack([-towards, towards], axis=1), np.array([-wrong, wrong], np.float32))
        rate = RATE * (1 - (step - 1) / steps)
        for w, gradient, (m, v) in zip((vectors, layer, bias), found, state, strict=True):
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient * gradient - v)
            change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
            w -= change if w is not vectors else change * used[:, None]
    whole[stay] = vectors
    return Model(whole, layer, bias)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS, seed: int = 11, buckets: int = BUCKETS) -> Model:
    """What ``fit`` does over all documents, for texts that a caller has in memory."""
    row, at, value = _sample_bags(texts, buckets)
    weights = weights / weights.sum()

    def pull_of(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> Pull:
        def pull(scores: np.ndarray, offset: float) -> tuple[np.ndarray, float]:
            z = np.bincount(row, weights=value * scores[at], minlength=len(texts)) + offset
            wrong = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * weights).astype(np.float32)
            return np.bincount(at, weights=value * wrong[row], minlength=len(scores)), wrong.sum()

        return pull

    def narrow(stay: np.ndarray) -> Pull:
        new = np.full(buckets, -1)
        new[stay] = np.arange(len(stay))
        keep = new[at] >= 0
        return pull_of(row[keep], new[at[keep]], value[keep])

    return _descend(np.bincount(at, minlength=buckets) > 0, pull_of(row, at, value), narrow, steps, seed)


def _pieces(text: str) -> Iterator[str]:
    """A text cut at blanks, which no n-gram contains, into pieces of PIECE characters; a longer word makes its piece longer."""
    begin = 0
    while begin < len(text):
        end = begin + PIECE
        if end < len(text):
            last = text.rfind(" ", begin, end)
            end = last if last > begin else text.find(" ", end)
        yield text[begin : end if end > 0 else len(text)]
        begin = end if end > 0 else len(text)


# Of each document that is learned from: its labels 1 and 0, its n-grams, its bag (see _bag), and its batch.
BAGS = "good long, bad long, total long, bag binary, batch int"
# The most that an entry of a bag holds: a distance, and a number of n-grams.
FAR, MANY = (1 << 12) - 1, (1 << 4) - 1


@dataclass
class _Bags:
    """Documents of a task: the entries of one from offsets[i] on are buckets ``at`` in order with ``times`` n-grams."""

    good: np.ndarray
    bad: np.ndarray
    total: np.ndarray
    batch: pa.Array
    offsets: np.ndarray
    at: np.ndarray
    times: np.ndarray

    def by_document(self, values: np.ndarray) -> np.ndarray:
        """The sum of the values of the entries of each document."""
        out, some = np.zeros(len(self.total)), np.diff(self.offsets) > 0
        if some.any():
            out[some] = np.add.reduceat(values, self.offsets[:-1][some], dtype=np.float64)
        return out

    def buckets(self) -> np.ndarray:
        """The buckets of each document, once each."""
        row = np.repeat(np.arange(len(self.total)), np.diff(self.offsets))
        again = (self.at[1:] == self.at[:-1]) & (row[1:] == row[:-1])
        first = np.append(True, ~again)[: len(row)]
        # An entry of no n-gram comes before all that have its bucket, if any.
        some = np.add.reduceat(self.times, np.flatnonzero(first), dtype=np.int64) > 0 if len(row) else np.zeros(0, bool)
        return self.at[first][some]


def _begins(offsets: np.ndarray) -> np.ndarray:
    """The first entry of each row that has any."""
    return offsets[:-1][np.diff(offsets) > 0]


def _bag(at: np.ndarray, times: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of entries as binaries of 16 bits an entry: the distance from the bucket before, and the number of n-grams.

    Of a larger distance entries of no n-gram take what does not fit; of a larger number entries at distance 0 do.
    """
    gap = np.diff(at, prepend=0)
    gap[_begins(offsets)] = at[_begins(offsets)]
    before = np.maximum(gap - 1, 0) // FAR
    after = np.maximum(times - 1, 0) // MANY
    size = before + 1 + after
    ends = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1] + before, size)
    far = np.where(place < 0, FAR, np.where(place == 0, np.repeat(gap - before * FAR, size), 0))
    last = np.repeat(after, size)
    many = np.where(place < 0, 0, np.where(place < last, MANY, np.repeat(times, size) - last * MANY))
    data = pa.py_buffer(((far << 4) + many).astype("<u2").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((2 * ends[offsets]).astype(np.int32)), data])


def _record(x: _Bags) -> pa.RecordBatch:
    counts = [pa.array(n, pa.int64()) for n in (x.good, x.bad, x.total)]
    return pa.RecordBatch.from_arrays([*counts, _bag(x.at, x.times, x.offsets), x.batch], ["good", "bad", "total", "bag", "batch"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bags]:
    """The rows of BAGS in parts of about ENTRIES entries, one document at least."""
    for batch in batches:
        column = batch.column(3).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2 if len(column) else np.zeros(1, np.int64)
        entries = np.frombuffer(data, "<u2") if data is not None and len(data) > 1 else np.zeros(0, "<u2")
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + ENTRIES, side="right")) - 1)
            part, own = entries[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            gap = part >> 4
            at, begins = np.cumsum(gap, dtype=np.int64), _begins(own)
            size = np.diff(own)
            at -= np.repeat(at[begins] - gap[begins], size[size > 0])
            good, bad, total = (batch.column(i)[begin:end].to_numpy() for i in range(3))
            yield _Bags(good, bad, total, batch.column(4)[begin:end], own, at, part & MANY)
            begin = end


def _learned(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(good, bad, batch, text) of all labelled documents, and the number of batches."""
    count = lambda y: F.count(F.when(F.col("label") == y, True))
    known = labels.groupBy("id").agg(count(1).alias("good"), count(0).alias("bad"))
    texts = documents.where("id is not null and text is not null").select("id", "text")
    if fits_broadcast(known):
        join = lambda rows, key: rows.join(F.broadcast(known), "id")
    else:
        texts = texts.where(may_match(F.col("id"), bit_filter(known, "id", known.count())))
        join = lambda rows, key: salted_join(rows, known, "id", "inner", key)
    both = join(texts.select("id"), ["id"]).agg(F.sum("good"), F.sum("bad")).first()
    batches = max(1, min(MOST_BATCHES, min(n or 0 for n in both) // PER_BATCH))
    batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch")
    return join(texts, ["id", "text"]).select("good", "bad", batch, "text"), batches


def _bagged(rows: DataFrame) -> DataFrame:
    """BAGS of rows (good, bad, batch, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, PIECE):
                texts = part.column(3).to_pylist()
                if len(texts) == 1:
                    whole = sum((np.bincount(b, n, BUCKETS) for _, b, n in (counts([x]) for x in _pieces(texts[0]))), np.zeros(BUCKETS))
                    bucket = np.flatnonzero(whole)
                    row, times = np.zeros(len(bucket), np.int64), whole[bucket].astype(np.int64)
                else:
                    row, bucket, times = counts(texts)
                offsets = np.searchsorted(row, np.arange(len(texts) + 1))
                total = np.bincount(row, times, len(texts)).astype(np.int64)
                good, bad = (part.column(i).to_numpy() for i in range(2))
                yield _record(_Bags(good, bad, total, part.column(2), offsets, bucket, times))

    return rows.mapInArrow(work, BAGS)


def _narrowed(rows: DataFrame, stay: np.ndarray) -> DataFrame:
    """BAGS with the entries of these buckets only, numbered by their place among them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = np.full(BUCKETS, -1)
        new[stay] = np.arange(len(stay))
        for x in _read(batches):
            keep = (new[x.at] >= 0) & (x.times > 0)
            offsets = np.concatenate([[0], np.cumsum(keep)])[x.offsets]
            yield _record(_Bags(x.good, x.bad, x.total, x.batch, offsets, new[x.at[keep]], x.times[keep].astype(np.int64)))

    return rows.mapInArrow(work, BAGS)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """BAGS written by batch, so that a step reads only its own."""
    path = new_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema(BAGS).parquet(path)


def _sums(rows: DataFrame, work: Callable[[_Bags], np.ndarray], size: int) -> np.ndarray:
    """The sum of the arrays of this size, of whole numbers, that work gives for the rows of BAGS."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for x in _read(batches):
            total += work(x).astype(np.int64)
        parts = [_packed(total[i : i + SUMS]) for i in range(0, size, SUMS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(_unpacked(x.as_py()) for x in table.column("sums"))
        return pa.table({"part": table.column("part")[:1], "sums": pa.array([_packed(total)], pa.binary())})

    kind = "part int, sums binary"
    got = rows.mapInArrow(task, kind).groupBy("part").applyInArrow(added, kind).toArrow().to_pylist()
    out = np.zeros(size, np.int64)
    for r in got:
        out[r["part"] * SUMS :][:SUMS] = _unpacked(r["sums"])
    return out


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, the sign last: bytes of small numbers are mostly zeros, which a shuffle compresses."""
    signed = (values << 1) ^ (values >> 63)
    return signed.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    signed = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8")[:, 0]
    return (signed >> np.uint64(1)).astype(np.int64) ^ -(signed & np.uint64(1)).astype(np.int64)


def _pull(rows: DataFrame, batches: int, size: int) -> Pull:
    """The gradient over one batch after another of rows of BAGS, whose buckets are below size."""
    own = [rows.where(F.col("batch") == i) for i in range(batches)]
    turn = 0

    def pull(scores: np.ndarray, offset: float) -> tuple[np.ndarray, float]:
        nonlocal turn
        scores = scores.astype(np.float32)

        def work(x: _Bags) -> np.ndarray:
            scale = SCALE / np.maximum(x.total, 1)
            z = x.by_document(scores[x.at] * x.times) * scale + offset
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            wrong = x.good * MISSED * (p - 1) + x.bad * p
            each = np.repeat(np.rint(wrong * scale * UNIT), np.diff(x.offsets))
            each *= x.times
            g = np.bincount(x.at, each, size)
            return np.concatenate([g, [np.rint(wrong * UNIT).sum(), np.rint((x.good * MISSED + x.bad) * UNIT).sum()]])

        got = _sums(own[turn], work, size + 2).astype(float)
        turn = (turn + 1) % batches
        got /= max(1.0, got[-1])
        return got[:-2], got[-2]

    return pull


def _constant(share: float) -> tuple[np.ndarray, float]:
    """The model whose every score is this share."""
    return np.zeros(1, np.float32), float(np.log((share + 1e-12) / (1 - share + 1e-12)))


def fit(documents: DataFrame, labels: DataFrame, per_label: int | None = None) -> tuple[np.ndarray, float]:
    """(weight, offset) of a model trained on all labelled documents.

    documents: id, text; labels: id, label (0 or 1). With per_label, it is trained on the driver instead, on a sample of at most so many
    documents of each label.
    """
    known = labels.where("id is not null and label in (0, 1)").select("id", "label")
    if per_label is not None:
        return _fit_sample(documents, known, per_label)
    texts, batches = _learned(documents, known)
    rows = _stored(_bagged(texts), "bags")

    def spread(x: _Bags) -> np.ndarray:
        return np.append(np.bincount(x.buckets(), minlength=BUCKETS), [x.good.sum(), x.bad.sum()])

    found = _sums(rows, spread, BUCKETS + 2)
    often, (good, bad) = found[:-2] >= LEAST_DOCUMENTS, found[-2:]
    if not good or not bad:
        return _constant(known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0])

    def narrow(stay: np.ndarray) -> Pull:
        return _pull(_stored(_narrowed(rows, stay), "bags-narrowed"), batches, len(stay))

    model = _descend(often, _pull(rows, batches, BUCKETS), narrow, STEPS, seed=11)
    return model.weight, model.offset


def _fit_sample(documents: DataFrame, known: DataFrame, per_label: int) -> tuple[np.ndarray, float]:
    """A model trained on a bounded sample (texts in bytes too, sampling.within_bytes), weighted back to the shares of all labels."""
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = sample(known, "label", "id", per_label)
    texts = documents.where("text is not null").join(F.broadcast(chosen), "id").select("id", "label", "text")
    texts = within_bytes(texts, "label", "id", per_label)
    rows = sorted(texts.toArrow().to_pylist(), key=lambda r: (str(r["id"]), r["label"], r["text"]))
    have = {x: sum(r["label"] == x for r in rows) for x in (0, 1)}
    if not have[0] or not have[1]:
        return _constant(shares.get(1, 0) / max(1, sum(shares.values())))
    truth = np.array([r["label"] for r in rows], float)
    weights = np.array([shares[r["label"]] / have[r["label"]] * (MISSED if r["label"] else 1) for r in rows])
    model = train([r["text"] for r in rows], truth, weights)
    return model.weight, model.offset


def _scored(batches: Iterator[pa.RecordBatch], text: int, weight: np.ndarray, offset: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, part, size = [], [], 0
        for value in batch.column(text):
            part.append(value.as_py() or "")
            size += len(part[-1])
            if size >= PIECE:
                out.append(sums(part, weight))
                part, size = [], 0
        out.append(sums(part, weight) if part else np.zeros(0))
        z = np.concatenate(out) + offset
        score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])


def score(rows: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """rows with score; rows has a column text and no column score."""
    weight, offset = model
    text = rows.columns.index("text")
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.mapInArrow(lambda batches: _scored(batches, text, weight, offset), schema)
