"""N-gram Jaccard join by count vectors in an R-tree.

A document's set holds the hashes of its distinct shingles; equal sets are one
class from the start.  Two sets whose Jaccard similarity reaches the threshold
share a shingle among the first few of each in any common order, so classes are
grouped by those shingles, hashes in order, shingles that very many documents
hold last.  Inside a group the shingles of each class, hashed into cells and
counted up to three in planes of bits, are a point; the points lie in an R-tree
whose nodes bound the overlap with a query by the summed minima of its
coordinates and the node's largest, and what the planes don't count.  Groups of a
leaf's size have all their pairs bounded at once.  Pairs whose bound reaches the
overlap that the threshold asks for are verified on the sets themselves.

Pairs come in rounds: a class is first compared with its smallest such partner
alone, linked classes melt into components, and only groups that still hold
several components go on.  In the rounds that follow a class is compared with the
partner of another component whose bound is best, as long as half of those that
ask are linked by it, and at last with all partners that are left.  In all rounds
but the last a class meets but a part of one of its larger groups, another each
time.  So no link between components can be missed, while a group of thousands of
near copies costs a few pairs a class.  In the last round large groups of much the
same classes are one crowd, in which each pair meets once, and of a crowd only
classes outside its largest component travel to several tasks.

Hashes have 64 bits, for shingles and for sets; equal hashes count as equal.

Defined results: a text of fewer words than a shingle is one shingle of all its
words; null texts and texts without words have empty sets and link with nothing;
repeated rows belong to one class; very long texts are one set like others; ties
go to the smallest key; extra columns are left out; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Rolling, Scratch, bounded_batches, components, lean, mix64, slices, spread, text_bytes

WORDS = 5
#: Threshold of the Jaccard similarity, as a fraction.
ABOVE, BELOW = 3, 4
#: Documents from which a shingle counts as frequent; most frequent shingles that workers are told of (4 bytes each).
FREQUENT, FREQUENT_MOST = 64, 1_000_000
#: Postings of one bucket, about; rows up to which a side is broadcast; most members of a group on each side of a tile.
BUCKET, BROADCAST_ROWS, TILE = 1 << 19, 1_000_000, 512
#: Members of groups that one bucket of the search holds, about.
SEARCHED = 50_000
#: Rounds at least, before the last, in which a class meets one part of one of its larger groups and a bucket names one partner of it.
SPARE = 2
#: Classes beside one centre in one task of the verification.
BESIDE = 256
#: Bytes of blobs that a task gathers before it hands them on.
GATHER = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of all shingles of texts laid end to end, by text; a long text is read in parts."""
    if len(offsets) != 2 or len(data) <= 2 * SLICE_BYTES:
        return _shingles(data, offsets)[:2]
    out, start, size = [], 0, SLICE_BYTES
    while start < len(data):
        space = np.flatnonzero(_SPACE[data[start + size : start + 2 * size]])
        end = start + size + int(space[0]) if len(space) else len(data) if start + 2 * size >= len(data) else 0
        part = data[start:end]
        _, h, words = _shingles(part, np.array([0, len(part)])) if end else (None, None, [])
        if len(words) < WORDS and end < len(data):  # few long words: look farther
            size *= 2
            continue
        if not out or len(words) >= WORDS:
            out.append(h)
        if end == len(data):
            break
        start, size = start + int(words[1 - WORDS]), SLICE_BYTES  # the last words begin the next part's shingles
    h = np.concatenate(out)
    return np.zeros(len(h), np.int64), h


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash) by text, and where the words start once a space stands after each text."""
    n = len(offsets) - 1
    apart = np.full(len(data) + n, 32, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = _LOWER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_SPACE[apart], [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    text = np.searchsorted(offsets + np.arange(n + 1), start, "right") - 1
    word = Rolling(apart).ranges(start, end)
    words = np.bincount(text, minlength=n)
    count = np.where(words >= WORDS, words - WORDS + 1, (words > 0).astype(words.dtype))
    at = spread(np.cumsum(words) - words, count)
    who = np.repeat(np.arange(n), count)
    size = np.minimum(words, WORDS)[who]
    h = size.astype(np.uint64)
    for k in range(WORDS):
        more = size > k
        if more.all():
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) ^ word[at + k])
        else:
            h[more] = mix64(h[more] * np.uint64(0x9E3779B97F4A7C15) ^ word[at[more] + k])
    return who, h, start


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of the distinct shingles of texts laid end to end, sorted."""
    who, h = shingles(data, offsets)
    ends = np.cumsum(np.bincount(who, minlength=len(offsets) - 1)).tolist()
    for a, b in zip([0, *ends], ends):
        h[a:b].sort()
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])]) if len(h) else np.zeros(0, bool)
    return who[new], h[new]


def set_keys(who: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The size and a hash of each set."""
    size = np.bincount(who, minlength=n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h), dtype=np.uint64)])
    ends = np.cumsum(size)
    return size, mix64((sums[ends] - sums[ends - size]) ^ size.astype(np.uint64)).view(np.int64)


def set_parts(batches):
    """(batch, first row, end row, text numbers, hashes) for slices of batches whose second column is text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets):
            yield (batch, a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


class Gather:
    """Arrays by bucket, handed on as rows (bucket, blob..) once they have GATHER bytes."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.bytes = bits, [], 0

    def add(self, h: np.ndarray, *others: np.ndarray) -> None:
        self.parts.append((h, *others))
        self.bytes += sum(x.nbytes for x in self.parts[-1])

    def rows(self):
        import pyarrow as pa

        if self.bytes:
            arrays = [np.concatenate(x) for x in zip(*self.parts)]
            bucket = (arrays[0] >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(arrays[0]), np.int64)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            ends = [*first[1:], len(order)]
            blobs = [pa.array([x[order[a:b]].tobytes() for a, b in zip(first, ends)], pa.binary()) for x in arrays]
            yield pa.RecordBatch.from_arrays([pa.array(found), *blobs], names=["bucket", *"hkmp"[: len(blobs)]])
        self.parts, self.bytes = [], 0


def _all_shingles(bits: int):
    """The first 32 bits of the lower half of all shingles' hashes, by bucket: the first few in order are among them.

    Each bucket's blob holds every hash once, `more` those that came again with how often they did.
    """

    def run(batches):
        import pyarrow as pa

        def rows():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            n -= 1
            found, first = np.unique(h >> np.uint32(32 - bits), return_index=True)
            ends = [*first[1:], len(h)]
            more = [np.stack([h[a:b][n[a:b] > 0], n[a:b][n[a:b] > 0].astype(np.uint32)], 1).tobytes() for a, b in zip(first, ends)]
            blobs = [pa.array([h[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()), pa.array(more, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *blobs], names=["bucket", "h", "more"])

        parts, size = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                _, h = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                parts.append((h[h < np.uint64(1 << 63)] >> np.uint64(32)).astype(np.uint32))
                size += parts[-1].nbytes
                if size > GATHER:
                    yield rows()
                    parts, size = [], 0
        if size:
            yield rows()

    return run


def _frequent(least: int):
    def run(key, rows):
        import pyarrow as pa

        h, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("h").to_pylist()]), return_counts=True)
        again = np.frombuffer(b"".join(rows.column("more").to_pylist()), np.uint32).reshape(-1, 2)
        np.add.at(n, np.searchsorted(h, again[:, 0]), again[:, 1].astype(n.dtype))
        return pa.table({"h": h[n >= least].astype(np.int64), "n": n[n >= least].astype(np.int64)})

    return run


def _postings(bits: int, frequent):
    """Two kinds of rows: a set's size, hash and count vector (id, n, key, cells), and by bucket the first shingles of sets, frequent ones last."""

    def run(batches):
        import pyarrow as pa

        def posted():
            for r in gather.rows():
                none = pa.nulls(len(r), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(r), pa.binary()), none, r.columns[0], *r.columns[2:]], names=NAMES)

        often, gather = frequent.value, Gather(bits)
        for batch, a, b, who, h in set_parts(batches):
            size, key = set_keys(who, h, b - a)
            late = np.zeros(len(h), bool)
            if len(often):
                short = (h >> np.uint64(32)).astype(np.uint32)
                late = often[np.minimum(np.searchsorted(often, short), len(often) - 1)] == short
            first = np.cumsum(size) - size
            rare = np.concatenate([[0], np.cumsum(~late)])  # rank in a text: the rare in order, then the frequent in order
            own, before = rare[first + size] - rare[first], rare[:-1] - rare[first][who]
            rank = np.where(late, own[who] + np.arange(len(h)) - first[who] - before, before)
            take = rank < (size - -(-ABOVE * size // BELOW) + 1)[who]
            gather.add(h[take], (h[take] >> np.uint64(32 - bits)).astype(np.uint32), key[who[take]])
            cells = [count_vector(h[x : x + n]) for x, n in zip(first.tolist(), size.tolist())]
            none = pa.nulls(b - a, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(size), pa.array(key), pa.array(cells, pa.binary()), batch.column(2).slice(a, b - a), pa.nulls(b - a, pa.int64()), none, none], names=NAMES
            )
            if gather.bytes > GATHER:
                yield from posted()
        yield from posted()

    return run


NAMES = ["id", "n", "key", "cells", "hash", "bucket", "h", "k"]


def _groups(key, rows):
    """Groups of classes with a common posting, those with the same members once; 32 bits of the hash beside the bucket tell postings apart."""
    import pyarrow as pa

    h, k = (np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()]) for c, t in (("h", np.uint32), ("k", np.int64)))
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
    h, k = h[new], k[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    many = np.diff(np.concatenate([first, [len(h)]]))
    first, many = first[many > 1], many[many > 1]
    at = spread(first, many)
    group = np.repeat(np.arange(len(first)), many)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(k[at].view(np.uint64)), dtype=np.uint64)])
    ends = np.cumsum(many)
    sign = mix64(sums[ends] - sums[ends - many]).view(np.int64)
    _, once = np.unique(sign, return_index=True)
    keep = np.isin(group, once)
    at, group = at[keep], group[keep]
    return pa.table({"sign": sign[group], "key": k[at]})


def cells_of(n: int) -> int:
    """Cells that a set of n shingles is counted in: a power of two, n or more up to 65,536."""
    return 1 << min(16, max(6, (int(n) - 1).bit_length()))


def count_vector(h: np.ndarray) -> bytes:
    """A set's counts up to 3, as three planes of bits: cells with one shingle or more, with two, with three."""
    cells = cells_of(len(h))
    counts = np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits(counts >= np.arange(1, 4)[:, None], axis=1, bitorder="little").tobytes()


def folded(planes: np.ndarray) -> np.ndarray:
    """Count vectors (rows, 3, bytes) with half as many cells."""
    half = planes.shape[2] // 2
    a, b = planes[:, :, :half], planes[:, :, half:]
    one, two, three = (a[:, k] | b[:, k] for k in range(3))
    return np.stack([one, two | (a[:, 0] & b[:, 0]), three | (a[:, 1] & b[:, 0]) | (a[:, 0] & b[:, 1])], 1)


class Points:
    """The count vectors of classes in the order of their keys, at every number of cells at which pairs are bounded."""

    def __init__(self, n: np.ndarray, blobs: list[bytes]):
        self.n, self.cells = n, np.array([cells_of(x) for x in n.tolist()], np.int64)
        self.levels = {}
        for c in np.unique(self.cells).tolist():
            own, more = np.flatnonzero(self.cells == c), np.flatnonzero(self.cells == 2 * c)
            planes = np.frombuffer(b"".join([blobs[i] for i in own]), np.uint8).reshape(len(own), 3, c // 8)
            if len(more):
                planes = np.concatenate([planes, folded(np.frombuffer(b"".join([blobs[i] for i in more]), np.uint8).reshape(len(more), 3, c // 4))])
            words = np.ascontiguousarray(planes).view(np.uint64).reshape(len(planes), -1)
            at = np.full(len(n), -1, np.int32)
            at[np.concatenate([own, more])] = np.arange(len(words))
            rest = np.concatenate([n[own], n[more]]) - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
            self.levels[c] = at, words, rest  # what the planes don't count of each set

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bound leaves it possible that pairs of classes link."""
        return (ABOVE + BELOW) * self.overlap(a, b) >= ABOVE * (self.n[a] + self.n[b])

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most that pairs of classes can share; -1 where their sizes alone rule a link out."""
        n, out, cells = self.n, np.full(len(a), -1), np.minimum(self.cells[a], self.cells[b])
        sized = np.flatnonzero(BELOW * np.minimum(n[a], n[b]) >= ABOVE * np.maximum(n[a], n[b]))
        for c in np.unique(cells[sized]).tolist():
            at, words, rest = self.levels[c]
            some = sized[cells[sized] == c]
            step = max(1, (1 << 19) // words.shape[1])
            for i in range(0, len(some), step):
                pick = some[i : i + step]
                x, y = at[a[pick]], at[b[pick]]
                out[pick] = np.bitwise_count(words[x] & words[y]).sum(axis=1, dtype=np.int64) + np.minimum(rest[x], rest[y])
        return out


class RTree:
    """Count vectors under boxes of FAN children each, in the order of their sizes and then of their first cells."""

    FAN = 32

    def __init__(self, words: np.ndarray, rest: np.ndarray, size: np.ndarray):
        band = (np.log(size) / np.log(BELOW / ABOVE)).astype(np.int64)
        self.order = np.lexsort((*words[:, 2::-1].T, band))
        size = size[self.order]
        self.levels = [(words[self.order], rest[self.order], size, size)]
        while len(self.levels[-1][0]) > self.FAN:
            box, rest, least, most = self.levels[-1]
            first = np.arange(0, len(box), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(box, first, axis=0), np.maximum.reduceat(rest, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)))

    def near(self, point: np.ndarray, rest: int, size: int) -> np.ndarray:
        """Points whose bounded overlap with the query reaches what the threshold asks for."""
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            box, more, least, most = (x[nodes] for x in self.levels[level])
            overlap = np.bitwise_count(box & point).sum(axis=1, dtype=np.int64) + np.minimum(more, rest)
            needed = np.maximum(least, -(-ABOVE * size // BELOW))
            nodes = nodes[(ABOVE * least <= BELOW * size) & (BELOW * most >= ABOVE * size) & ((ABOVE + BELOW) * overlap >= ABOVE * (size + needed))]
            if level:
                nodes = (nodes[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        return self.order[nodes]


def leaf_pairs(points: Points, at: np.ndarray, first: np.ndarray, many: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The possible pairs (larger, smaller) of different components inside groups that are one leaf, each once."""
    out, a = [np.zeros(0, np.int64)], 0
    done = np.cumsum(many * (many - 1) // 2)
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + (1 << 20))))
        place = spread(first[a:b], many[a:b])
        later = np.repeat(first[a:b] + many[a:b], many[a:b]) - place - 1
        x, y = np.repeat(at[place], later), at[spread(place + 1, later)]
        x, y = np.maximum(x, y), np.minimum(x, y)
        apart = comp[x] != comp[y]
        out.append(np.unique(x[apart] * len(comp) + y[apart]))
        a = b
    pairs = np.unique(np.concatenate(out))
    x, y = pairs // max(1, len(comp)), pairs % max(1, len(comp))
    good = points.possible(x, y)
    return x[good], y[good]


def tree_pairs(points: Points, index: np.ndarray, asked: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The possible pairs (larger, smaller) of different components between the classes of an R-tree and those that ask it."""
    out = [(index[:0], index[:0])]
    for c, (at, words, rest) in points.levels.items():
        held, query = index[at[index] >= 0], asked[at[asked] >= 0]
        if not len(held) or not len(query):
            continue
        tree = RTree(words[at[held]], rest[at[held]], points.n[held])
        for q in query.tolist():
            found = held[tree.near(words[at[q]], int(rest[at[q]]), int(points.n[q]))]
            found = found[(comp[found] != comp[q]) & (np.minimum(points.cells[found], points.cells[q]) == c)]
            out.append((np.maximum(found, q), np.minimum(found, q)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _search(one: bool, near: bool):
    """For the tiles of a bucket, rows (a, b, share): all pairs, or `one` partner b of each class a.

    That is the smallest, or with `near` the one whose bound is the largest share of both sets.
    """

    def run(key, rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        own = rows.filter(pc.is_valid(rows.column("n"))).sort_by("key")
        k, n, comp = (own.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "component"))
        points = Points(n, own.column("cells").to_pylist())
        del own
        rows = rows.filter(pc.is_null(rows.column("n"))).select(["sign", "p", "q", "side", "key"])
        sign, p, q, side, at = (rows.column(c).to_numpy() for c in ("sign", "p", "q", "side", "key"))
        at = np.searchsorted(k, at)
        order = np.lexsort((at, q, p, sign))
        sign, p, q, side, at = sign[order], p[order], q[order], side[order], at[order]
        cut = np.concatenate([[0], np.flatnonzero((sign[1:] != sign[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1])
        many = np.diff(np.append(cut, len(sign)))
        leaf = (many <= RTree.FAN) & (p[cut] == q[cut]) if len(sign) else np.zeros(0, bool)
        found = [leaf_pairs(points, at, cut[leaf], many[leaf], comp)] if leaf.any() else []
        for x, m in zip(cut[~leaf].tolist(), many[~leaf].tolist()) if len(sign) else ():
            part, apart = at[x : x + m], side[x : x + m] == 1
            found.append(tree_pairs(points, part[apart] if apart.any() else part, part[~apart], comp))
        a, b = (np.concatenate(v) for v in zip(*found)) if found else (k[:0], k[:0])
        pairs = np.unique(a * max(1, len(k)) + b)
        a, b = pairs // max(1, len(k)), pairs % max(1, len(k))
        share = np.zeros(len(a))
        if one:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            share = points.overlap(a, b) / (n[a] + n[b]) if near else np.zeros(len(a))
            order = np.lexsort((b, -share, a))
            a, b, share = a[order], b[order], share[order]
            first = np.ones(len(a), bool)
            first[1:] = a[1:] != a[:-1]
            a, b, share = a[first], b[first], share[first]
        return pa.table({"a": k[a], "b": k[b], "share": share})

    return run


def _verify(key, rows):
    """The classes whose exact similarity to the centre reaches the threshold."""
    import pyarrow as pa

    a, blobs = rows.column("a").to_pylist(), rows.column("hashes").to_pylist()
    centre, kept = next(np.frombuffer(s, np.uint64) for x, s in zip(a, blobs) if x is None), []
    for x, blob in zip(a, blobs):
        s = np.frombuffer(blob, np.uint64)
        both = int((centre[np.minimum(np.searchsorted(centre, s), len(centre) - 1)] == s).sum())
        if x is not None and (ABOVE + BELOW) * both >= ABOVE * (len(s) + len(centre)):
            kept.append(x)
    return pa.table({"a": pa.array(kept, pa.int64()), "b": pa.array([key[0].as_py()] * len(kept), pa.int64())})


def small(df: DataFrame) -> DataFrame:
    """Broadcast a written table if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sets_of(scratch: Scratch, texts: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """The sets (key, hashes) of some classes, each from one of its texts."""
    asked = scratch.write(keys.join(classes, "key").select("rep", "hash"), "asked")
    known = texts.join(small(asked.filter("rep is not null").select("rep")), texts.id == F.col("rep")).select("id", "text")
    nameless = texts.filter("id is null").withColumn("hash", F.xxhash64("text"))
    nameless = nameless.join(small(asked.filter("rep is null").select("hash")), "hash").dropDuplicates(["hash"]).select("id", "text")
    out = known.unionByName(nameless).mapInArrow(lean(_sets), "key bigint, hashes binary").join(small(keys), "key", "left_semi")
    return scratch.write(out.dropDuplicates(["key"]), "sets")


def verified(scratch: Scratch, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked pairs among (a, b): every class a travels to the centre b, a centre with many to several tasks."""
    parts = scratch.write(pairs.groupBy("b").agg(F.ceil(F.count("*") / BESIDE).cast("int").alias("parts")), "parts")
    placed = pairs.join(small(parts), "b").select("b", F.pmod(F.hash("a"), F.col("parts")).alias("part"), "a")
    centre = parts.select("b", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(None).cast("bigint").alias("a"))
    beside = placed.withColumn("key", F.col("a")).unionByName(centre.withColumn("key", F.col("b")))
    beside = small(scratch.write(beside, "beside")).join(sets, "key").select("b", "part", "a", "hashes")
    return scratch.write(beside.groupBy("b", "part").applyInArrow(_verify, "a bigint, b bigint"), "linked")


#: Columns of the rows that tiles hold.
TILES = ["sign", "p", "q", "side", "key", "component", "many", "first"]


def crowds(scratch: Scratch, wide: DataFrame) -> DataFrame:
    """Groups (sign, key, component, first) with those that share classes laid together, where the whole has fewer pairs than they have."""
    low = wide.join(wide.groupBy("key").agg(F.min("first").alias("low")), "key").groupBy("sign")
    low = scratch.write(low.agg(F.min("low").alias("crowd"), F.count("*").cast("double").alias("many")), "crowds")
    pairs = low.groupBy("crowd").agg(F.sum(F.col("many") * F.col("many")).alias("pairs"))
    whole = scratch.write(wide.join(small(low.select("sign", "crowd")), "sign").select(F.col("crowd").alias("sign"), "key", "component", F.col("crowd").alias("first")).distinct(), "whole")
    sums = whole.groupBy("sign").agg(F.count("*").cast("double").alias("many")).join(pairs.withColumnRenamed("crowd", "sign"), "sign")
    fewer = small(scratch.write(sums.filter("many * many < pairs").select("sign"), "fewer"))
    alone = small(scratch.write(low.join(fewer.withColumnRenamed("sign", "crowd"), "crowd", "left_anti").select("sign"), "alone"))
    return whole.join(fewer, "sign", "left_semi").unionByName(wide.join(alone, "sign", "left_semi").select(whole.columns))


def crowd_tiles(scratch: Scratch, wide: DataFrame, buckets: int) -> DataFrame:
    """The tiles (p, q, side) of large groups in which all pairs of different components meet.

    The classes of a group's largest component come once, each in one of its
    parts, which all others of the group visit; the others, in parts of their
    own, meet by pairs of parts.  Parts are about TILE classes, but no more than
    keep the buckets busy, so a class comes as often as there are parts to keep
    busy, not as its group is large; only from SEARCHED classes a part they are
    more, for the memory of a task, and over SEARCHED visitors all are others.
    """
    held = scratch.write(crowds(scratch, wide), "held")
    sums = held.groupBy("sign", "component").agg(F.count("*").alias("n")).groupBy("sign")
    sums = sums.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("many"))
    sums = sums.withColumn("main", F.expr(f"if(many - most <= {SEARCHED}, main, null)")).withColumn("most", F.expr("if(main is null, 0, most)")).withColumn("rest", F.expr("many - most"))
    busy = 2 * int(buckets**0.5) + 1

    def parts(of: str, alone: str):
        return F.expr(f"cast(least({alone}, greatest({busy}, ceil({of} / {SEARCHED}))) as int)")

    sums = sums.withColumn("mains", parts("most", f"ceil(most * least(rest, {TILE}) / {TILE**2})")).withColumn("rests", parts("rest", f"ceil(rest / {TILE})"))
    held = held.join(small(scratch.write(sums.select("sign", "main", "many", "mains", "rests"), "mains")), "sign").withColumn("hash", F.hash("key"))
    once = held.filter("component = main").withColumn("p", F.expr("-1 - pmod(hash, mains)"))
    once = once.withColumn("q", F.col("p")).withColumn("side", F.lit(1))
    others = held.filter("not component <=> main").withColumn("part", F.expr("pmod(hash, rests)")).withColumn("other", F.explode(F.expr("sequence(-mains, rests - 1)")))
    others = others.withColumn("p", F.expr("if(other < 0, other, least(part, other))")).withColumn("q", F.expr("if(other < 0, other, greatest(part, other))"))
    others = others.withColumn("side", F.expr("cast(other >= 0 and part > other as int)"))
    return once.select(TILES).unionByName(others.select(TILES))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_shingles, component_id): the size of each set and the smallest key its links reach."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    total = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6  # shingles, about
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bits(rows: float) -> int:
        return max(tasks - 1, int(rows / BUCKET)).bit_length()

    least = max(FREQUENT, int(8 * total / 2**32))
    frequent = texts.select("id", "text").mapInArrow(lean(_all_shingles(bits(total / 4))), "bucket bigint, h binary, more binary").groupBy("bucket")
    frequent = scratch.write(frequent.applyInArrow(_frequent(least), "h bigint, n bigint"), "frequent")
    most = frequent.orderBy(F.desc("n"), "h").limit(FREQUENT_MOST).select("h").toArrow().column("h").to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(most.astype(np.uint32)))
    scratch.drop(frequent)
    scratch.release()

    kinds = "id bigint, n bigint, key bigint, cells binary, hash bigint, bucket bigint, h binary, k binary"
    hashed = texts.select("id", "text", F.when(F.col("id").isNull(), F.xxhash64("text")).alias("hash"))
    found = scratch.write(hashed.mapInArrow(lean(_postings(bits(total / 4), shared)), kinds), "postings")
    sizes = scratch.write(found.filter("bucket is null").select("id", "n", "key", "hash"), "sizes")
    classes = sizes.filter("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.min("hash").alias("hash"))
    classes = scratch.write(classes, "classes")
    groups = found.filter("bucket is not null").select("bucket", "h", "k").groupBy("bucket")
    groups = scratch.write(groups.applyInArrow(_groups, "sign bigint, key bigint"), "buckets")
    member = scratch.write(groups.dropDuplicates(["sign", "key"]).withColumn("component", F.col("key")), "groups")
    scratch.drop(groups)
    live = scratch.write(member.select("key").distinct(), "live")
    points = found.filter("bucket is null").select("key", "n", "cells").join(small(live), "key").dropDuplicates(["key"])
    points = scratch.write(points, "points")
    scratch.drop(found)
    scratch.release()

    judged, edges = spark.createDataFrame([], "a bigint, b bigint"), None
    turn, spare = 0, True
    while True:
        parts = F.ceil(F.count("*") / TILE).cast("int")
        mixed = member.groupBy("sign").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("key").alias("first"), parts.alias("parts"), F.count("*").alias("many"))
        mixed = scratch.write(mixed.filter("low < high").select("sign", "first", "parts", "many"), "mixed")
        many, wide = mixed.agg(F.sum("many"), F.count_if(F.col("parts") > 1)).first()
        buckets = (many or 0) // SEARCHED + tasks
        placed = scratch.write(member.join(mixed, "sign"), "placed")
        large = mixed.filter(F.col("many") > RTree.FAN)
        tiles = placed
        if spare:  # near copies share most of their groups, so one of the larger and a part of it will do at first
            own = placed.filter(F.col("many") > RTree.FAN).groupBy("key").agg(F.min_by("sign", F.xxhash64("sign", F.lit(turn))).alias("sign"))  # another in each round
            tiles = placed.filter(F.col("many") <= RTree.FAN).unionByName(placed.join(own, ["key", "sign"]).select(placed.columns))
        # at first other groups part a class otherwise; at last alike, so that pairs of large groups meet in the same few tiles
        tiles = tiles.withColumn("p", F.pmod(F.hash("sign", "key", F.lit(turn)), "parts")).withColumn("q", F.col("p")).withColumn("side", F.lit(0))
        if not spare and wide:
            tiles = tiles.filter("parts = 1").select(TILES).unionByName(crowd_tiles(scratch, placed.filter("parts > 1"), buckets))
        # small groups with the same first class, which are as many as its first shingles at most, meet in one bucket,
        # large ones in a few for each pair of parts, so that a pair of theirs comes once or a few times
        bucket = F.when(F.col("many") <= RTree.FAN, F.hash("first")).otherwise(F.hash("first", "p", "q", F.pmod(F.hash("sign"), F.lit(4))))
        tiles = scratch.write(tiles.select(F.pmod(bucket, F.lit(buckets)).alias("bucket"), "sign", "p", "q", "side", "key", "component"), "tiles")
        scratch.drop(placed)
        placed = tiles.select("bucket", "key", "component").distinct().join(points, "key")
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("sign", "bigint"), ("p", "int"), ("q", "int"), ("side", "int"))]
        placed = placed.select("bucket", *none, "key", "component", "n", "cells")
        rows = tiles.select("bucket", "sign", "p", "q", "side", "key", F.lit(None).cast("bigint").alias("component"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("cells"))
        named = scratch.write(rows.unionByName(placed).groupBy("bucket").applyInArrow(_search(spare, turn > 0), "a bigint, b bigint, share double").distinct(), "named")
        scratch.drop(tiles)
        pairs = named.groupBy("a").agg(F.min_by("b", F.struct(-F.col("share"), "b")).alias("b")) if spare else named
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = scratch.write(pairs.join(judged, ["a", "b"], "left_anti"), "pairs")
        links = 0
        if not pairs.isEmpty():
            keys = scratch.write(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "keys")
            sets = sets_of(scratch, texts, classes, keys)
            linked = verified(scratch, pairs, sets)
            scratch.drop(sets)
            edges = linked if edges is None else edges.unionByName(linked)
            judged, links = judged.unionByName(pairs), linked.count()
        if not spare or (named.isEmpty() and large.isEmpty()):
            break
        # who has had no partner at all has none later, but for large groups, of which the first rounds see no whole
        touched = scratch.write(named.select(F.col("a").alias("key")).distinct(), "touched")
        stays = member.join(touched, "key", "left_semi")
        stays = stays.unionByName(member.join(touched, "key", "left_anti").join(large, "sign", "left_semi"))
        if edges is not None:
            parts = scratch.write(components(scratch, edges), "components")
            stays = stays.drop("component").join(parts.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        before, member = member, scratch.write(stays.select("sign", "key", "component"), "member")
        scratch.drop(before)
        scratch.release()
        turn += 1
        spare = turn < SPARE or 0 < touched.count() <= 2 * links  # as long as half of the classes that ask find a link
    out = sizes.select("id", "n", "key").join(classes.select("key", "rep"), "key", "left")
    if edges is not None:
        parts = components(scratch, edges)
        lowest = parts.withColumnRenamed("id", "key").join(classes, "key").groupBy("component").agg(F.min("rep").alias("low"))
        parts = scratch.write(parts.join(lowest, "component").select(F.col("id").alias("key"), "low"), "result")
        out = out.join(small(parts), "key", "left")
    else:
        out = out.withColumn("low", F.lit(None).cast("bigint"))
    scratch.drop(points)
    scratch.release()
    alone = F.when(F.col("n") > 0, F.coalesce("low", "rep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), alone.alias("component_id"))


def _sets(batches):
    """Every text's set."""
    import pyarrow as pa

    for _, a, b, who, h in set_parts(batches):
        size, key = set_keys(who, h, b - a)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([x.tobytes() for x in np.split(h, np.cumsum(size)[:-1])], pa.binary())], names=["key", "hashes"])
