"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of a text's bytes forwards and backwards, gives every
position the probabilities of each language, and a document the mean over the
positions of its letters. It is trained here, in numpy, by backpropagation through
time on a bounded sample; prediction reads every byte of every text.

Defined cases. A null text, or one without a letter, is ``und`` with score 0. Rows
with a null language or id are not learned from. Without any row to learn from every
text is ``und``; with one language every text with letters is that language.
Repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tuneprep.llm.sampling import sample, within_bytes
from tuneprep.llm.words import slices, text_bytes

UNDETERMINED = "und"
HIDDEN = 8
WINDOW = 64
# Windows that run side by side; bounds the memory of a prediction.
SIDE_BY_SIDE = 2048
# Bounds of the training sample.
DOCUMENTS_PER_LANGUAGE = 400
WINDOWS_PER_LANGUAGE = 2500
STEPS = 500
BATCH = 128
RATE = 0.01

ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LETTERS = ASCII_LETTERS | (np.arange(256) >= 0x80)


@dataclass
class Network:
    """inputs: (2, 3H, 256), one column per byte; recurrent: (2, 3H, H); out: (L, 2H); out_bias: (L).

    The rows of a direction are update gate, reset gate and candidate.
    """

    languages: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            languages,
            draw(0.3, 2, 3 * hidden, 256),
            draw(1 / np.sqrt(hidden), 2, 3 * hidden, hidden),
            draw(0.3, len(languages), 2 * hidden),
            np.zeros(len(languages), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.out, self.out_bias]


def _squash(x: np.ndarray) -> None:
    """In place, the rational form of tanh that reaches -1 and 1 at -3 and 3: x (27 + x^2) / (27 + 9 x^2)."""
    np.clip(x, -3, 3, out=x)
    square = x * x
    x *= square + 27
    square *= 9
    square += 27
    x /= square


def _slope(x: np.ndarray) -> np.ndarray:
    """The derivative of _squash."""
    square = np.minimum(x * x, 9)
    return ((9 - square) / (9 + 3 * square)) ** 2


def _states(net: Network, direction: int, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The state at each position, (T, H, B), of one direction over windows (T, B). keep gets what backpropagation needs."""
    steps, side = windows.shape
    hidden = net.recurrent.shape[2]
    # A gate is (1 + squash(x / 2)) / 2: with halved rows one pass serves gates and candidate.
    half = np.concatenate([np.full(2 * hidden, 0.5), np.ones(hidden)]).astype(net.inputs.dtype)[:, None]
    inputs, recurrent = net.inputs[direction] * half, net.recurrent[direction] * half
    state, out = np.zeros((hidden, side), inputs.dtype), np.empty((steps, hidden, side), inputs.dtype)
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        a = np.take(inputs, windows[t], axis=1, mode="clip")
        u = recurrent @ state
        gates = a[: 2 * hidden]
        gates += u[: 2 * hidden]
        slope = _slope(gates) / 4 if keep is not None else None
        _squash(gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:hidden], gates[hidden:]
        n = a[2 * hidden :]
        u = u[2 * hidden :]
        n += r * u
        if keep is not None:
            keep.append((t, z, r, slope[:hidden], slope[hidden:], _slope(n), n, u, state))
        _squash(n)
        after = state - n
        after *= z
        after += n
        state = out[t] = after
    return out


def _probabilities(net: Network, both: np.ndarray) -> np.ndarray:
    """(T, L, B) from the states (T, 2H, B)."""
    scores = np.matmul(net.out, both)
    scores += net.out_bias[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def _backwards(net: Network, direction: int, windows: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
    """Gradients of inputs and recurrent weights of one direction, from those of its states (T, H, B)."""
    hidden, side = grad.shape[1:]
    recurrent = net.recurrent[direction]
    d_rows = np.empty((windows.shape[0], 3 * hidden, side), recurrent.dtype)
    d_recurrent = np.zeros_like(recurrent)
    d_state = np.zeros((hidden, side), recurrent.dtype)
    for t, z, r, z_slope, r_slope, n_slope, n, u, before in reversed(kept):
        d = grad[t] + d_state
        dn = d * (1 - z) * n_slope
        dz = d * (before - n) * z_slope
        dr = dn * u * r_slope
        d_rows[t] = np.concatenate([dz, dr, dn])
        du = np.concatenate([dz, dr, dn * r])
        d_recurrent += du @ before.T
        d_state = d * z + recurrent.T @ du
    flat, at = d_rows.transpose(1, 0, 2).reshape(3 * hidden, -1), windows.ravel()
    return [np.stack([np.bincount(at, weights=row, minlength=256) for row in flat]).astype(recurrent.dtype), d_recurrent]


def gradients(net: Network, windows: np.ndarray, counted: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the counted positions of windows (T, B), and its gradient by each weight."""
    kept: list[list] = [[], []]
    both = np.concatenate([_states(net, i, windows, kept[i]) for i in (0, 1)], axis=1)
    probabilities = _probabilities(net, both)
    weight = counted / max(1, counted.sum())
    side = np.arange(len(labels))
    loss = -float((np.log(probabilities[:, labels, side] + 1e-9) * weight).sum())
    probabilities[:, labels, side] -= 1
    d_scores = probabilities * weight[:, None, :].astype(probabilities.dtype)
    d_out = np.einsum("tlb,thb->lh", d_scores, both, optimize=True)
    d_both = np.matmul(net.out.T, d_scores)
    hidden = net.recurrent.shape[2]
    parts = [_backwards(net, i, windows, kept[i], d_both[:, i * hidden : (i + 1) * hidden]) for i in (0, 1)]
    return loss, [np.stack([parts[0][k], parts[1][k]]) for k in range(2)] + [d_out, d_scores.sum((0, 2))]


def cut(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (T, B) of all rows, padded with 0, which of their positions are letters, and the row of each."""
    lengths = np.diff(offsets)
    counts = -(-lengths // window)
    rows = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (offsets[:-1][rows] + number * window)[None, :] + np.arange(window)[:, None]
    inside = at < offsets[1:][rows]
    windows = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else at
    windows = windows.astype(np.intp)
    return windows, LETTERS[windows] & inside, rows


def train(texts: list[str], labels: list[str], hidden: int = HIDDEN, window: int = WINDOW, steps: int = STEPS, seed: int = 7) -> Network:
    """Fit a network to texts by Adam; as many windows of each language, however long its texts are."""
    languages = sorted(set(labels))
    net = Network.fresh(languages, hidden, seed)
    if len(languages) < 2:
        return net
    windows, counted, rows = cut(*text_bytes(pa.array(texts, pa.large_string())), window)
    truth = np.array([languages.index(x) for x in labels])[rows]
    rng = np.random.default_rng(seed)
    enough = counted.sum(0) > 0
    chosen = [rng.permutation(np.flatnonzero((truth == i) & enough))[:WINDOWS_PER_LANGUAGE] for i in range(len(languages))]
    chosen = [x for x in chosen if len(x)]
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(x, -(-BATCH // len(chosen))) for x in chosen])
        _, found = gradients(net, windows[:, picked], counted[:, picked], truth[picked])
        scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in found)) + 1e-12))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for weight, gradient, m, v in zip(net.weights(), found, first, second, strict=True):
            gradient = gradient * scale
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient * gradient - v)
            weight -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(weight.dtype)
    return net


def positions(net: Network, windows: np.ndarray) -> np.ndarray:
    """The probabilities of each language at each position, (T, L, B)."""
    return _probabilities(net, np.concatenate([_states(net, i, windows) for i in (0, 1)], axis=1))


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(rows, L): the mean over the letters of a row; zeros where there is none. Long rows go through in parts."""
    sums = np.zeros((len(offsets) - 1, len(net.languages)))
    letters = np.zeros(len(offsets) - 1)
    span = SIDE_BY_SIDE * window
    # Parts of about span bytes that begin at a window of some row.
    row, done = 0, 0
    while row < len(offsets) - 1:
        begin = offsets[row] + done
        last = int(np.searchsorted(offsets, begin + span, side="right")) - 1
        if last <= row:
            pieces, size = np.array([0, min(span, offsets[row + 1] - begin)]), None
        else:
            pieces, size = offsets[row : last + 1] - begin, last
            pieces[0] = 0
        windows, counted, rows = cut(data[begin : begin + pieces[-1]], pieces, window)
        for i in range(0, len(rows), SIDE_BY_SIDE):
            part = slice(i, i + SIDE_BY_SIDE)
            pooled = np.einsum("tlb,tb->bl", positions(net, windows[:, part]), counted[:, part].astype(np.float32), optimize=True)
            np.add.at(sums, rows[part] + row, pooled)
            np.add.at(letters, rows[part] + row, counted[:, part].sum(0))
        if size is None:
            done += int(pieces[-1])
            if offsets[row] + done >= offsets[row + 1]:
                row, done = row + 1, 0
        else:
            row, done = size, 0
    return sums / np.maximum(letters, 1)[:, None]


def _has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a letter of any script; only rows without an ASCII letter are looked at as text."""
    before = np.concatenate([[0], np.cumsum(ASCII_LETTERS[data])])
    found = before[offsets[1:]] > before[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")))
    return found


def _predicted(net: Network, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, text)):
        data, offsets = text_bytes(batch.column(text))
        letter = _has_letter(batch.column(text), data, offsets)
        if net.languages:
            probabilities = document_probabilities(net, data, offsets)
            best = probabilities.argmax(1)
            score = np.clip(np.where(letter, probabilities[np.arange(len(best)), best], 0.0), 0.0, 1.0)
            names = np.where(letter, np.array(net.languages, object)[best], UNDETERMINED)
        else:
            score, names = np.zeros(len(letter)), np.full(len(letter), UNDETERMINED, object)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
        )


def fit(rows: DataFrame, per_language: int = DOCUMENTS_PER_LANGUAGE) -> Network:
    """Train on at most per_language documents of each language, bounded in bytes too. rows: id, text, lang."""
    known = rows.where("id is not null and text is not null and lang is not null").select("id", "text", "lang")
    chosen = within_bytes(sample(known, "lang", "id", per_language), "lang", "id", per_language).toArrow().to_pylist()
    chosen.sort(key=lambda r: (r["lang"], str(r["id"]), r["text"]))
    return train([r["text"] for r in chosen], [r["lang"] for r in chosen])


def identify(rows: DataFrame, net: Network) -> DataFrame:
    """rows with lang_pred and score; rows has a column text and neither of these two."""
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    text = rows.columns.index("text")
    return rows.mapInArrow(lambda batches: _predicted(net, batches, text), schema)
