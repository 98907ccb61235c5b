"""Toxicity by a factorization machine over hashed terms.

A term is a word (lower case, A-Z only; white space and ASCII punctuation
separate words) or the first four or five bytes of a longer word; it enters as a
64-bit hash, once for each text.  The machine's score of a text is

    bias + sum w[t] + 1/(2n) * sum_f ((sum v[t,f])^2 - sum v[t,f]^2)

over its n known terms t: the last part learns pairs of terms, such as an insult near a
group's name, that no sum of single weights can tell apart.  Only terms that
several texts of the training sample have get weights, so the model's size is
bounded by the sample, and a hash can't stand for an unknown term by chance.

Defined results: a null or empty text has no terms and gets the bias alone;
repeated rows score alike; rows without a label aren't learned from; extra
columns are left out; an empty table gives an empty table, and a table without
two classes of labels a constant score of the positive share (0 without any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import HashIndex, Rolling, bounded_batches, cut_at, labelled_texts, lean, slices, text_bytes

#: Bounds of the training sample for each label: rows, and bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16 << 20
#: Texts of the sample that must have a term before it gets weights; factors of each term; mini-batches, their size and rate.
LEAST_TEXTS, FACTORS = 4, 4
STEPS, BATCH, RATE = 375, 128, 0.1
#: Shrinkage of each weight in a step (towards 0, as an L1 penalty), so that common terms of long texts add up to nothing.
SHRINK = 3e-3
#: Probability from which a text counts as toxic.
THRESHOLD = 0.7

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of every term occurrence in texts laid end to end."""
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    cut = offsets[1:-1]  # a word that reaches over the end of a text is two words
    if len(cut):
        k = np.searchsorted(start, cut, "right") - 1
        inside = (k >= 0) & (start[np.maximum(k, 0)] < cut) & (end[np.maximum(k, 0)] > cut) if len(start) else np.zeros(len(cut), bool)
        cuts = np.unique(cut[inside])
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    text = np.searchsorted(offsets, start, "right") - 1
    roll = Rolling(_LOWER[data])
    out, who = [roll.ranges(start, end)], [text]
    for n in (4, 5):
        longer = end - start > n
        out.append(roll.ranges(start[longer], start[longer] + n) ^ np.uint64(n))
        who.append(text[longer])
    return np.concatenate(who), np.concatenate(out)


class FactorizationMachine:
    """Weights of known terms; scores whole arrays of texts."""

    def __init__(self, keys: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.keys, self.bias, self.w, self.v, self.slope, self.shift = keys, bias, w, v, slope, shift
        self.index = HashIndex(keys)

    def arrays(self) -> tuple:
        """What the machine is made of again, without this class."""
        return self.keys, self.bias, self.w, self.v, self.slope, self.shift

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        for a, b in slices(offsets):
            part, pairs = data[offsets[a] : offsets[b]], []
            # a long text is read in parts, which words don't cross
            for x, y in cut_at(part, ~_WORD) if b == a + 1 else [(0, len(part))]:
                who, key = terms(part[x:y], offsets[a : b + 1] - offsets[a] if b > a + 1 else np.array([0, y - x]))
                at = self.index.find(key)
                pairs.append(np.unique((who[at >= 0].astype(np.int64) << 32) | at[at >= 0]))
            pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            total[a:b] += self.raw(pair >> 32, pair & 0xFFFFFFFF, b - a)
        return 1 / (1 + np.exp(-np.clip(self.slope * total + self.shift, -40, 40)))

    def raw(self, who: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        half = 0.5 / np.maximum(1, np.bincount(who, minlength=n))
        out = np.bincount(who, self.w[at], n).astype(float)  # without terms it would count in integers
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += half * (np.bincount(who, x, n) ** 2 - np.bincount(who, x * x, n))
        return out


def fit(data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> FactorizationMachine:
    """Learn from texts laid end to end, by AdaGrad on mini-batches with weight decay; the classes weigh alike."""
    n = len(label)
    empty = np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS))
    if not n or label.min() == label.max():
        share = min(max(float(label.mean()) if n else 0.0, 1e-6), 1 - 1e-6)
        return FactorizationMachine(empty[0], float(np.log(share / (1 - share))), *empty[1:])
    who, key = [], []
    for a, b in slices(offsets):
        x, k = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order = np.lexsort((k, x))
        x, k = x[order], k[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (k[1:] != k[:-1])]) if len(x) else np.zeros(0, bool)
        who.append(x[new] + a)
        key.append(k[new])
    who, key = np.concatenate(who), np.concatenate(key)
    keys, at, texts = np.unique(key, return_inverse=True, return_counts=True)
    often = np.flatnonzero(texts >= LEAST_TEXTS)
    place = np.full(len(keys), -1)
    place[often] = np.arange(len(often))
    at = place[at]
    who, at = who[at >= 0], at[at >= 0]
    keys = keys[often]
    random = np.random.default_rng(7)
    w, v = np.zeros(len(keys)), random.normal(0, 0.01, (len(keys), FACTORS))
    gw, gv, bias, gb = np.full(len(keys), 1e-3), np.full(v.shape, 1e-3), 0.0, 1e-3
    weight = np.where(label == 1, n / (2 * (label == 1).sum()), n / (2 * (label == 0).sum()))
    first = np.searchsorted(who, np.arange(n + 1))
    for _ in range(-(-STEPS * BATCH // n)):
        order = random.permutation(n)
        for i in range(0, n, BATCH):
            rows = order[i : i + BATCH]
            lengths = first[rows + 1] - first[rows]
            pick = np.repeat(first[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            x, t = np.repeat(np.arange(len(rows)), lengths), at[pick]
            half = 0.5 / np.maximum(1, lengths)
            sums = np.stack([np.bincount(x, v[t, f], len(rows)) for f in range(FACTORS)], 1)
            z = bias + np.bincount(x, w[t], len(rows))
            z += half * ((sums**2).sum(1) - np.bincount(x, (v[t] ** 2).sum(1), len(rows)))
            d = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[rows]) / len(rows)
            bias -= RATE * d.sum() / np.sqrt(gb := gb + d.sum() ** 2)
            if not len(t):
                continue
            u, t = np.unique(t, return_inverse=True)
            dx, dh = d[x], (2 * d * half)[x]
            g = np.bincount(t, dx, len(u))
            gw[u] += g * g
            w[u] -= RATE * g / np.sqrt(gw[u])
            w[u] = np.sign(w[u]) * np.maximum(0, np.abs(w[u]) - SHRINK)
            g = np.stack([np.bincount(t, dh * sums[x, f], len(u)) for f in range(FACTORS)], 1)
            g -= v[u] * np.bincount(t, dh, len(u))[:, None]
            gv[u] += g * g
            v[u] -= RATE * g / np.sqrt(gv[u])
            v[u] = np.sign(v[u]) * np.maximum(0, np.abs(v[u]) - SHRINK / 10)
    used = (w != 0) | (v != 0).any(axis=1)
    keys, w, v = keys[used], w[used], v[used]
    model = FactorizationMachine(keys, float(bias), w, v)
    place = np.full(len(used), -1)
    place[used] = np.arange(len(keys))
    at = place[at]
    model.slope, model.shift = calibrate(bias + model.raw(who[at >= 0], at[at >= 0], n), label, weight / n)
    return model


def calibrate(z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the labels best, by Newton steps with a small ridge."""
    middle, scale = z.mean(), z.std() or 1.0
    x, b = np.stack([(z - middle) / scale, np.ones(len(z))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        ridge = np.diag([1e-4, 1e-8])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - label)) + ridge @ b)
        b -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return float(b[0] / scale), float(b[1] - b[0] * middle / scale)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> FactorizationMachine:
    """Fit on a sample of labelled texts that SAMPLE_ROWS and SAMPLE_BYTES bound for each label."""
    rows = labelled_texts(docs, labels, key, text, label, SAMPLE_ROWS, SAMPLE_BYTES)
    data, offsets = text_bytes(rows.column("x"))
    return fit(data, offsets, rows.column("y").to_numpy())


def score(docs: DataFrame, model: FactorizationMachine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score): the probability that each whole text is toxic."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        machine = FactorizationMachine(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.scores(*text_bytes(batch.column(1))))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, score double")
