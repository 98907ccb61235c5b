"""Language identification by unigram piece models, summed over all segmentations.

The pieces are all byte strings of a fixed public vocabulary file.  Each
language has a probability for every piece, learnt by expectation-maximisation.
A text is cut at white space into words, each with one space before it; a word's
probability in a language is the sum over all its segmentations into pieces,
which the forward algorithm gives exactly, and a text's the product over its
words.  The words of a batch are scored together: a padded matrix for each bucket
of lengths, one column after the other, for all languages at once.  Of the
forward sums a window of the longest piece's length is kept, scaled as it goes,
so words of any length have all their segmentations summed.

Learning counts words of more than FIT_BYTES bytes, as scripts without spaces
have them, in parts of that size between characters; scoring never cuts a word.

Defined results: texts that are null or have no letter (Unicode category L) are
`und` with score 0; repeated rows score alike; ties go to the first language in
alphabetical order; rows without a key or a language aren't learned from; extra
columns are left out; an empty table gives an empty table; without any labelled
text all is `und`.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, Rolling, Scratch, bounded_batches, bounded_sample, lean, process_cache

#: Bounds of the training sample for each language: rows, and bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 500, 2 << 20
#: Rounds of expectation-maximisation; pseudo-count of each piece.
ROUNDS, PSEUDO = 3, 0.05
#: Longest part of a word that learning counts as a whole, in bytes with the space.
FIT_BYTES = 48
#: Words that a worker remembers, and their bytes; beyond either its memory starts afresh.
REMEMBERED, REMEMBERED_BYTES = 400_000, 8 << 20
#: Longest words whose matrices are of similar length to four bytes.
SHORT = 64
#: Columns between two scalings of the forward sums; cells of a matrix of words.
SCALED, CELLS = 16, 1 << 16
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is of the category L; the pattern alone takes some numbers, as \u00bd, for letters."""
    return any(m[0].isalpha() for m in _LETTERS.finditer(text))


def pieces_of(path: str) -> list[bytes]:
    """The byte strings of a rank file, every single byte among them."""
    with open(path, "rb") as f:
        own = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted({p for p in own if p} | {bytes([b]) for b in range(256)})


def words_of(text: str) -> list[str]:
    return text.split()


def byte_word(word: str) -> bytes:
    return b" " + word.encode("utf-8", "replace")


def fit_parts(word: str) -> list[bytes]:
    """A word with its space, in parts of FIT_BYTES bytes at most that end between characters."""
    raw, out = byte_word(word), []
    while len(raw) > FIT_BYTES:
        end = FIT_BYTES
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[:end])
        raw = raw[end:]
    return [*out, raw]


class Pieces:
    """Finds the pieces at every place of many words at once."""

    def __init__(self, pieces: list[bytes]):
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        end = np.cumsum(size)
        self.n, self.longest, self.lengths = len(pieces), int(size.max()), np.unique(size)
        self.index = HashIndex(Rolling(data).ranges(end - size, end))

    def buckets(self, words: list[bytes]):
        """Buckets of words of similar length: (rows, sizes, padded matrix of bytes)."""
        size = np.array([len(w) for w in words])
        bucket = np.where(size <= SHORT, (size + 3) // 4, SHORT + np.ceil(np.log2(size + 1)).astype(int))
        for b in np.unique(bucket):
            rows_all = np.flatnonzero(bucket == b)
            room = max(1, CELLS // int(size[rows_all].max()))
            for i in range(0, len(rows_all), room):
                rows = rows_all[i : i + room]
                data = np.zeros((len(rows), int(size[rows].max())), np.uint8)
                data[np.arange(data.shape[1]) < size[rows, None]] = np.frombuffer(b"".join([words[k] for k in rows]), np.uint8)
                yield rows, size[rows], data

    def starting(self, data: np.ndarray, size: np.ndarray, first: int, last: int) -> np.ndarray:
        """found[row, j, l - 1]: the piece of length l that starts at column first + j, n for none."""
        part = np.zeros((len(data), last - first + self.longest), np.uint8)
        end = min(data.shape[1], last + self.longest)
        part[:, : end - first] = data[:, first:end]
        roll = Rolling(part.ravel())
        at = (np.arange(len(data))[:, None] * part.shape[1] + np.arange(last - first)).ravel()
        width = min(self.longest, data.shape[1] - first)
        out = np.full((len(data), last - first, width), self.n, np.int32)
        for n in self.lengths[self.lengths <= width].tolist():
            found = self.index.find(roll.ranges(at, at + n)).reshape(len(data), -1)
            found[(found < 0) | (np.arange(first, last) + n > size[:, None])] = self.n
            out[:, :, n - 1] = found
        return out


def log_forward(finder: Pieces, data: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The logarithm of the summed probability of all segmentations of each row, for each language of p."""
    rows, width, languages = len(data), data.shape[1], p.shape[1]
    window = np.zeros((finder.longest + 1, rows, languages))  # the sums at column j, j + 1, .. as far as pieces reach
    window[0] = 1
    scale, out = np.zeros((rows, languages)), np.zeros((rows, languages))
    step = max(SCALED, min(width, CELLS // rows) // SCALED * SCALED)
    for first in range(0, width, step):
        last = min(width, first + step)
        found = finder.starting(data, size, first, last)
        reach = found.shape[2]
        for j in range(last - first):
            window[1 : reach + 1] += (window[0][:, None] * p[found[:, j]]).transpose(1, 0, 2)
            window[:-1] = window[1:]
            window[-1] = 0
            done = size == first + j + 1
            if done.any():
                out[done] = np.log(window[0][done]) + scale[done]
            if (j + 1) % SCALED == 0:
                top = window.max(axis=0)
                top[top == 0] = 1  # rows that have ended
                window /= top
                scale += np.log(top)
    return out


def forward(ids: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[:, j]: the summed probability of all segmentations of the first j bytes of short words."""
    width = ids.shape[1]
    alpha = np.zeros((width + ids.shape[2] + 1, len(size), p.shape[1]))
    alpha[0] = 1
    for j in range(width):
        alpha[j + 1 : j + 1 + ids.shape[2]] += (alpha[j][:, None] * p[ids[:, j]]).transpose(1, 0, 2)
    return alpha


class LanguageModel:
    """Piece probabilities of each language, and the share of each language."""

    def __init__(self, pieces: list[bytes], languages: list[str], p: np.ndarray, prior: np.ndarray):
        self.pieces, self.languages, self.p, self.prior = pieces, languages, p, prior

    def arrays(self) -> tuple:
        """What the model is made of again, without this class."""
        return self.pieces, self.languages, self.p, self.prior

    def digest(self) -> str:
        """Of all that its scores hang on."""
        h = hashlib.sha256(repr((len(self.pieces), self.languages, self.p.shape)).encode())
        for x in (b"".join(self.pieces), np.array([len(x) for x in self.pieces]).tobytes(), self.p.tobytes(), self.prior.tobytes()):
            h.update(x)
        return h.hexdigest()

    def word_scores(self, finder: Pieces, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for rows, size, data in finder.buckets(words):
            out[rows] = log_forward(finder, data, size, self.p)
        return out


def fit(texts: list[str], languages: list[str], pieces: list[bytes]) -> LanguageModel:
    """Expectation-maximisation over the distinct words of each language; the start counts every piece found."""
    from collections import Counter

    names = sorted(set(languages))
    finder, prior = Pieces(pieces), np.array([languages.count(x) for x in names], float)
    counts: dict[bytes, np.ndarray] = {}
    for k, name in enumerate(names):
        seen = Counter(w for t, x in zip(texts, languages) if x == name for w in words_of(t))
        for word, n in seen.items():
            for raw in fit_parts(word):
                counts.setdefault(raw, np.zeros(len(names)))[k] += n
    words, weight = list(counts), np.array(list(counts.values())).reshape(len(counts), len(names))
    p = np.zeros((len(pieces) + 1, max(1, len(names))))
    p[:-1] = 1 / len(pieces)
    size_of = np.array([len(x) for x in pieces] + [1])
    for turn in range(ROUNDS if words else 0):
        expected = np.zeros_like(p)
        for rows, size, data in finder.buckets(words):
            ids, w, width = finder.starting(data, size, 0, data.shape[1]), weight[rows], data.shape[1]
            reach = ids.shape[2]
            if turn:
                alpha = forward(ids, size, p)
                total = np.maximum(alpha[size, np.arange(len(size))], 1e-300)
                beta = np.zeros((width + reach + 1, len(size), p.shape[1]))
                for j in range(width, -1, -1):
                    if j < width:
                        beta[j] = (p[ids[:, j]].transpose(1, 0, 2) * beta[j + 1 : j + 1 + reach]).sum(axis=0)
                    beta[j][size == j] = 1
            for j in range(width):
                found = ids[:, j]
                part = w[:, None] * (alpha[j][:, None] * p[found] * beta[j + 1 : j + 1 + reach].transpose(1, 0, 2) / total[:, None] if turn else np.ones((1, reach, 1)))
                for k in range(len(names)):
                    expected[:, k] += np.bincount(found.ravel(), part[:, :, k].ravel(), len(p))
        expected[-1] = 0
        if not turn:  # longer pieces hold shorter ones, so the plain counts favour the short
            expected *= (size_of**2)[:, None]
        expected[:-1] += PSEUDO
        p = expected / expected.sum(axis=0)
    return LanguageModel(pieces, names, p, prior / max(1, prior.sum()))


def train(docs: DataFrame, path: str, text: str = "text", language: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Fit on a sample of texts with a language that SAMPLE_ROWS and SAMPLE_BYTES bound for each language."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("x"), F.col(language).alias("y")).filter("x is not null and y is not null")
    rows = bounded_sample(Scratch(docs.sparkSession, "language"), rows, "k", "y", "x", SAMPLE_ROWS, SAMPLE_BYTES)
    return fit(rows.column("x").to_pylist(), rows.column("y").to_pylist(), pieces_of(path))


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score): the likeliest language of each whole text and its posterior probability."""
    bounded_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(model.arrays()), ("language", model.digest())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        model, cache = LanguageModel(*shared.value), process_cache()
        if cache.get("language") != name:  # one model's words at a time
            cache["language"] = name
            cache["language words"] = Pieces(model.pieces), {}, [np.zeros((0, len(model.languages)), np.float32), 0]
        finder, known, rows = cache["language words"]
        for batch in batches:
            if len(known) > REMEMBERED or rows[1] > REMEMBERED_BYTES:
                known.clear()
                rows[:] = [rows[0][:0], 0]
            texts = batch.column(1).to_pylist()
            good = [bool(t and model.languages and has_letter(t)) for t in texts]
            lines = [words_of(t) if g else [] for t, g in zip(texts, good)]
            new = list(set().union(*lines).difference(known)) if lines else []
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new))))
                rows[:] = [np.concatenate([rows[0], model.word_scores(finder, [byte_word(w) for w in new])]), rows[1] + sum(map(len, new))]
            at = np.fromiter((known[w] for x in lines for w in x), np.int64)
            ends = np.cumsum([0, *map(len, lines)])
            sums = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(rows[0][at], axis=0, dtype=float)])
            total = sums[ends[1:]] - sums[ends[:-1]] + np.log(np.maximum(model.prior, 1e-12))
            best = total.argmax(axis=1) if model.languages else np.zeros(len(texts), int)
            top = 1 / np.exp(np.minimum(700, total - total.max(axis=1, keepdims=True))).sum(axis=1) if model.languages else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.languages[b] if g else UNKNOWN for b, g in zip(best, good)], pa.string()), pa.array(np.where(good, top, 0.0))],
                names=[key, "lang_pred", "score"],
            )

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, lang_pred string, score double")
