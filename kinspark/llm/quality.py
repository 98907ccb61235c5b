"""Text quality by a convolutional network over bytes, in numpy.

Every byte of a text has a learnt vector.  Learnt filters read KERNEL bytes at
every STRIDE-th byte; their largest answers in chunks of two BLOCKs, each chunk
overlapping the next by one BLOCK, describe the chunk.  A hidden layer reads
each chunk's description, and the largest answer of each hidden unit over all
chunks of the text makes one probability.  The whole text is read, however long,
in slices of SLICE_BYTES, which memory follows.

Defined results: a null or empty text is one chunk of padding; repeated rows
score alike; rows without a label aren't learned from; extra columns are left
out; an empty table gives an empty table, and a table without two classes of
labels a constant score of the positive share (0.5 without any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, bounded_batches, labelled_texts, lean, slices, spread, text_bytes

#: Bounds of the training sample for each label: rows, and bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 6 << 20
STRIDE, KERNEL, BLOCK = 4, 8, 256
VECTOR, FILTERS, HIDDEN = 8, 24, 16
EPOCHS, BATCH, RATE = 8, 32, 0.004
#: Probability from which a text counts as good.
THRESHOLD = 0.3

_STEPS = BLOCK // STRIDE


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end, each filled up with zeros to one BLOCK or more, and each text's number of blocks."""
    size = np.diff(offsets)
    blocks = np.maximum(1, -(-size // BLOCK))
    out = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    out[spread((np.cumsum(blocks) - blocks) * BLOCK, size)] = data
    return out, blocks


class ByteNetwork:
    """The weights, by name, and what they make of texts."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def layers(self, data: np.ndarray, blocks: np.ndarray) -> dict:
        """The answers of all layers to padded texts."""
        w, last = self.weights, np.cumsum(blocks) - 1
        x = w["byte"][data].reshape(-1, STRIDE * VECTOR)
        both = x @ w["filter"]
        answer = both[:, :FILTERS]
        answer[:-1] += both[1:, FILTERS:]
        ends = (last[:-1] + 1) * _STEPS  # a text's last step must not read the next text
        answer[ends - 1] -= both[ends, FILTERS:]
        block = answer.reshape(-1, _STEPS, FILTERS)
        top = block.max(axis=1)
        after = np.minimum(np.arange(len(top)) + 1, np.repeat(last, blocks))
        chunk = np.maximum(np.maximum(top, top[after]) + w["filter0"], 0)
        hidden = np.maximum(chunk @ w["hidden"] + w["hidden0"], 0)
        first = last - blocks + 1
        pooled = np.maximum.reduceat(hidden, first, axis=0)
        z = pooled @ w["out"] + w["out0"]
        return {"x": x, "block": block, "top": top, "after": after, "chunk": chunk, "hidden": hidden, "pooled": pooled, "z": z, "first": first}

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for a, b in slices(offsets):
            part = data[offsets[a] : offsets[b]]
            if b == a + 1 and len(part) > 2 * SLICE_BYTES:
                out[a] = self.long_text(part)
            else:
                out[a:b] = self.layers(*padded(part, offsets[a : b + 1] - offsets[a]))["z"]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    def long_text(self, data: np.ndarray) -> float:
        """The last answer to one text, read in parts of SLICE_BYTES and the two blocks that these look into."""
        step, n, pooled = SLICE_BYTES // BLOCK, -(-len(data) // BLOCK), np.zeros(HIDDEN)
        for i in range(0, n, step):
            part = data[i * BLOCK : (i + step + 2) * BLOCK]
            hidden = self.layers(*padded(part, np.array([0, len(part)])))["hidden"]
            pooled = np.maximum(pooled, hidden[:step].max(axis=0))
        return float(pooled @ self.weights["out"] + self.weights["out0"][0])

    def gradients(self, data: np.ndarray, blocks: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy; each maximum passes it on to the place where it was reached."""
        w, a = self.weights, self.layers(data, blocks)
        dz = weight * (1 / (1 + np.exp(-np.clip(a["z"], -40, 40))) - label)
        out = {"out": a["pooled"].T @ dz, "out0": np.array([dz.sum()])}
        who = np.repeat(np.arange(len(blocks)), blocks)
        won = (a["hidden"] == a["pooled"][who]) & (a["hidden"] > 0)
        row, unit = np.nonzero(won)
        _, keep = np.unique(who[row] * HIDDEN + unit, return_index=True)
        row, unit = row[keep], unit[keep]
        dh = dz[who[row]] * w["out"][unit]
        rows, at = np.unique(row, return_inverse=True)
        d = np.zeros((len(rows), HIDDEN))
        d[at, unit] = dh
        chunk = a["chunk"][rows]
        out["hidden"], out["hidden0"] = chunk.T @ d, d.sum(axis=0)
        dc = (d @ w["hidden"].T) * (chunk > 0)
        out["filter0"] = dc.sum(axis=0)
        second = a["top"][a["after"][rows]] > a["top"][rows]
        source = np.where(second, a["after"][rows][:, None], rows[:, None])
        filters = np.broadcast_to(np.arange(FILTERS), source.shape)
        step = a["block"][source, :, filters].argmax(axis=2) + source * _STEPS
        live = dc != 0
        g, f, s = dc[live], filters[live], step[live]
        n = len(a["x"])
        last = np.isin(s + 1, np.concatenate([a["first"] * _STEPS, [n]]))
        grad, dx = np.zeros_like(w["filter"]), []
        here, nxt = np.zeros((FILTERS, STRIDE * VECTOR)), np.zeros((FILTERS, STRIDE * VECTOR))
        np.add.at(here, f, g[:, None] * a["x"][s])
        s2, g2, f2 = s[~last] + 1, g[~last], f[~last]
        np.add.at(nxt, f2, g2[:, None] * a["x"][s2])
        grad[:, :FILTERS], grad[:, FILTERS:] = here.T, nxt.T
        out["filter"] = grad
        places = np.concatenate([s, s2])
        dx = np.concatenate([g[:, None] * w["filter"].T[f], g2[:, None] * w["filter"].T[FILTERS + f2]])
        values = data.reshape(-1, STRIDE)[places].ravel()
        dx, out["byte"] = dx.reshape(-1, VECTOR), np.zeros_like(w["byte"])
        for k in range(VECTOR):
            out["byte"][:, k] = np.bincount(values, dx[:, k], 256)
        out["byte"][0] = 0
        return out


def fit(data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> ByteNetwork:
    """Adam over mini-batches of whole texts of similar length."""
    random, n = np.random.default_rng(11), len(label)
    share = float(label.mean()) if n else 0.5
    w = {
        "byte": random.normal(0, 0.5, (256, VECTOR)),
        "filter": random.normal(0, 0.25, (STRIDE * VECTOR, 2 * FILTERS)),
        "filter0": np.zeros(FILTERS),
        "hidden": random.normal(0, 0.3, (FILTERS, HIDDEN)),
        "hidden0": np.full(HIDDEN, 0.1),
        "out": random.normal(0, 0.3, HIDDEN),
        "out0": np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6))]),
    }
    w = {k: x.astype(np.float32) for k, x in w.items()}
    w["byte"][0] = 0
    if not n or share in (0.0, 1.0):
        w["out"][:] = 0
        return ByteNetwork(w)
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    one, two = ({k: np.zeros(x.shape) for k, x in w.items()} for _ in "ab")
    turn, net = 0, ByteNetwork(w)
    for epoch in range(EPOCHS):
        order = np.argsort(np.diff(offsets) * random.uniform(0.7, 1.4, n), kind="stable")
        for k in random.permutation(-(-n // BATCH)):
            rows = order[k * BATCH : (k + 1) * BATCH]
            size = np.diff(offsets)[rows]
            part, blocks = padded(data[spread(offsets[rows], size)], np.concatenate([[0], np.cumsum(size)]))
            grads = net.gradients(part, blocks, label[rows], weight[rows] / len(rows))
            turn += 1
            rate = RATE * (1 - epoch / EPOCHS * 0.8)
            for name, g in grads.items():
                one[name] += 0.1 * (g - one[name])
                two[name] += 0.002 * (g * g - two[name])
                step = (one[name] / (1 - 0.9**turn)) / (np.sqrt(two[name] / (1 - 0.998**turn)) + 1e-8)
                w[name] -= (rate * step).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> ByteNetwork:
    """Fit on a sample of labelled texts that SAMPLE_ROWS and SAMPLE_BYTES bound for each label."""
    rows = labelled_texts(docs, labels, key, text, label, SAMPLE_ROWS, SAMPLE_BYTES)
    data, offsets = text_bytes(rows.column("x"))
    return fit(data, offsets, rows.column("y").to_numpy())


def score(docs: DataFrame, model: ByteNetwork, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score): the probability that each whole text is good."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        net = ByteNetwork(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(*text_bytes(batch.column(1))))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, score double")
