"""Byte-level BPE: encoding by padded integer matrices, and decoding.

``encode`` gives the token ids of every whole text, ``decode`` the bytes of
every list of ids.  A text is cut by the pre-tokenisation pattern; the distinct
matches of a batch are sorted into buckets of similar length, one padded matrix
of ids for each.  In a round every row merges its leftmost pair of least rank,
found through a hashed table of mergeable pairs; merged rows close up by one
column, rows without a mergeable pair leave the matrix.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded each; extra columns are left out; an empty table
gives an empty table.  Matches of more than LONG bytes would need as many
rounds over as many columns, so they are merged with a heap instead, to the
same ids.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, bounded_batches, process_cache, spread, text_bytes

#: Matches over this many bytes take the heap.
LONG = 2048
#: Units a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 500_000
#: White space as Unicode defines it, which the pattern's \\s stands for.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = np.int32(2**31 - 1)


class Merges:
    """The vocabulary of a rank file and its table of mergeable pairs."""

    def __init__(self, ranks: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        size = max(self.ids.values()) + 1
        self.pieces = [b""] * size
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        self.made = np.array([*made, NONE], np.int32)
        self.pairs = HashIndex(self.key(np.array(left, np.int64), np.array(right, np.int64)))

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, NONE where it doesn't or one side is padding."""
        found = self.made[self.pairs.find(self.key(left, right).ravel())].reshape(left.shape)
        return np.where(right < 0, NONE, found)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has; a word that is a token is that token."""
        whole = np.array([self.ids.get(w, -1) if w else -2 for w in words], np.int32)
        size = np.array([len(w) for w in words], np.int64)
        single = np.flatnonzero(whole >= 0)
        done = [(single, np.ones(len(single), np.int64), whole[single])]
        rest = np.flatnonzero((whole == -1) & (size <= LONG))
        bits = np.ceil(np.log2(size[rest])).astype(int)
        for b in np.unique(bits):
            rows, room = rest[bits == b], max(1, (1 << 18) >> int(b))
            for i in range(0, len(rows), room):
                done += self.matrix([words[k] for k in rows[i : i + room]], rows[i : i + room])
        for k in np.flatnonzero((whole == -1) & (size > LONG)):
            ids = self.heap(words[k])
            done.append((np.array([k]), np.array([len(ids)]), ids))
        who, count, flat = (np.concatenate(x) for x in zip(*done))
        start = np.zeros(len(words), np.int64)
        lengths = np.zeros(len(words), np.int64)
        start[who], lengths[who] = np.cumsum(count) - count, count
        return flat[spread(start, lengths)], lengths

    def matrix(self, words: list[bytes], who: np.ndarray) -> list:
        """Merge the words of one bucket in rounds, each row its leftmost pair of least rank; gives (who, counts, ids)."""
        size = np.array([len(w) for w in words])
        width, done = int(size.max()), []
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        while len(who):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(who)), at]
            live = best != NONE
            if not live.all():
                ended = ids[~live]
                real = ended >= 0
                done.append((who[~live], real.sum(axis=1), ended[real]))
                ids, rank, who, at, best = ids[live], rank[live], who[live], at[live], best[live]
            n, row = ids.shape[1] - 1, np.arange(len(who))
            ids[row, at] = best
            ids = np.take_along_axis(ids, np.arange(n) + (np.arange(n) > at[:, None]), 1)
            if n < 2:
                rank = np.full((len(who), 1), NONE)
                continue
            rank = np.take_along_axis(rank, np.arange(n - 1) + (np.arange(n - 1) >= at[:, None]), 1)
            for a in (at, at - 1):
                ok = (a >= 0) & (a < n - 1)
                r, c = row[ok], a[ok]
                rank[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        return done

    def heap(self, word: bytes) -> np.ndarray:
        """One long word: a linked list of ids and a heap of its mergeable pairs."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = self.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        todo = [(int(r), i) for i, r in enumerate(start) if r != NONE]
        heapq.heapify(todo)
        now = {i: r for r, i in todo}

        def pair(i: int) -> None:
            now.pop(i, None)
            if i >= 0 and after[i] < n:
                made = self.ids.get(self.pieces[ids[i]] + self.pieces[ids[after[i]]])
                if made is not None:
                    now[i] = made
                    heapq.heappush(todo, (made, i))

        while todo:
            r, i = heapq.heappop(todo)
            if now.get(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            now.pop(j, None)
            if after[i] < n:
                before[after[i]] = i
            pair(i)
            pair(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)


class Encoder:
    """Texts to ids, with a memory of the units met before.

    A unit is what lies between two single spaces that have no white space
    beside them, with the space before it: no match of the pattern crosses such
    a space, so a unit has the same ids in every text.
    """

    def __init__(self, merges: Merges, pattern: str):
        import regex

        self.merges = merges
        own = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.words = regex.compile(own)
        self.cut = regex.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
        self.white = frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{WHITE}]", c))
        self.clear()

    def clear(self) -> None:
        self.known, self.tokens = {}, np.zeros(0, np.int32)
        self.length = self.start = np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        """The first unit and, with the space before them, the others."""
        parts = text.split(" ")
        fresh = set(parts).difference(self.seen)
        if fresh:
            self.odd.update(x for x in fresh if not x or x[0] in self.white or x[-1] in self.white)
            self.seen |= fresh
        return self.cut.split(text) if not self.odd.isdisjoint(parts) else parts

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of each text's."""
        if len(self.known) > REMEMBERED:
            self.clear()
        self.seen = set()
        self.odd = set()
        lines = [self.units(x) if x else [] for x in texts]
        firsts = [("\0", x[0]) for x in lines if x]  # no space before them
        new = {u for x in lines for u in x[1:]}.difference(self.known) | set(firsts).difference(self.known)
        if new:
            self.learn(list(new))
        known, total = self.known, []
        for x in lines:
            if x:
                total.append(known["\0", x[0]])
                total.extend(map(known.__getitem__, x[1:]))
        unit = np.array(total, np.int64)
        lengths = self.length[unit] if len(unit) else np.zeros(0, np.int64)
        ids = self.tokens[spread(self.start[unit], lengths)] if len(unit) else np.zeros(0, np.int32)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum([len(x) for x in lines])
        counts = np.diff(np.concatenate([[0], sums[ends]])) if len(lines) else np.zeros(0, np.int64)
        return ids, counts

    def learn(self, new: list) -> None:
        """Encode units met for the first time."""
        words = [self.words.findall(u[1] if isinstance(u, tuple) else " " + u) for u in new]
        per_unit = np.array(list(map(len, words)), np.int64)
        words = [w for x in words for w in x]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, lengths = self.merges.encode([w.encode() for w in distinct])
        word = np.array(list(map(distinct.__getitem__, words)), np.int64)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        sums = np.concatenate([[0], np.cumsum(lengths[word])])
        ends = np.concatenate([[0], np.cumsum(per_unit)])
        self.tokens = np.concatenate([self.tokens, ids[spread((np.cumsum(lengths) - lengths)[word], lengths[word])]])
        self.length = np.concatenate([self.length, np.diff(sums[ends])])
        self.start = np.cumsum(self.length) - self.length


def read_ranks(path: str) -> bytes:
    """A rank file, read on the driver; vocabularies have about a megabyte, which is what workers get."""
    with open(path, "rb") as f:
        ranks = f.read()
    if len(ranks) > 64 << 20:
        raise ValueError(f"{path}: {len(ranks)} bytes are too many for a vocabulary")
    return ranks


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>): the token ids of every whole text, without special tokens."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        cache, name = process_cache(), ("bpe", hash(ranks.value), pattern)
        if name not in cache:
            cache[name] = Encoder(Merges(ranks.value), pattern)
        coder = cache[name]
        for batch in batches:
            ids, counts = coder.batch(batch.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, ids, decoded binary): the bytes that each list of ids stands for; null ids count as none."""
    spark = tokens.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        cache, name = process_cache(), ("pieces", hash(ranks.value))
        if name not in cache:
            pairs = {int(b): base64.b64decode(a) for a, b in (x.split() for x in ranks.value.splitlines() if x)}
            pieces = [pairs.get(i, b"") for i in range(max(pairs) + 1)]
            size = np.array([len(x) for x in pieces], np.int64)
            cache[name] = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size
        flat, start, size = cache[name]
        for batch in batches:
            column = batch.column(1)
            counts = np.array(column.value_lengths().fill_null(0), np.int64)
            tokens = np.array(column.flatten(), np.int64)
            ends = np.concatenate([[0], np.cumsum(size[tokens])])[np.concatenate([[0], np.cumsum(counts)])]
            data = flat[spread(start[tokens], size[tokens])]
            out = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), column, out], names=[key, "ids", "decoded"])

    return tokens.select(key, F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary")
