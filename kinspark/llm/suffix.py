"""Repeated passages by a distributed difference-cover suffix array.

Every byte covered by a string of SPAN bytes that also starts in a document with
a smaller key is removed.

Sorting all suffixes of a corpus would move many times its size, so the suffixes
are first narrowed to those that can matter, without loss.  Anchors, the least
hash of the GRAM-byte strings in each window of SPAN bytes, are a cover: equal
strings of SPAN bytes have the same anchor at the same place.  An anchor's
surroundings are all the strings of SPAN bytes that hold it.  Documents with the
same surroundings of an anchor lose them to the first of them; that needs hashes
alone, and settles copies and the inside of long passages.  Where an anchor has
several surroundings, as at the ends of passages, the first document of each
sends its bytes once, with all its places that hold them; what is lost in them is
lost at each of these.  They are dealt out by anchor, and each task sorts the suffixes
of its share by the difference-cover algorithm: it sorts the triples at the
places that are no multiples of three, recurses on their names, sorts the other
suffixes by a letter and the rank after it, merges both and compares the first
SPAN bytes of neighbours.  Runs of equal prefixes give the least document of each
string.

Surroundings go by 64-bit hashes beside the anchor's own 32 or more bits;
sorted strings are compared byte by byte.

Defined results: a null text is empty; texts of fewer than SPAN bytes stay whole;
matches never cross documents; rows with the same key lose nothing to each other,
and where their texts differ each loses what earlier documents have of its own; a
row without a key stays whole; extra columns are left out; an empty
table gives an empty table.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Rolling, Scratch, bounded_batches, lean, mix64, slices, spread, text_bytes

SPAN, GRAM = 50, 24
#: Starts of strings that hold an anchor, and bytes around it that they reach.
STARTS = SPAN - GRAM + 1
#: Anchors of one bucket, about; bytes whose suffixes are sorted at once; surroundings of one anchor that one task sorts.
BUCKET, SORTED, CROWD = 1 << 18, 1 << 19, 20_000
#: Bytes of anchors that a task gathers before it hands them on.
GATHER = 4 << 20


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the anchors of texts laid end to end; a slice at most."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(data) - GRAM + 1
    if n < STARTS:
        return none
    at = np.arange(n)
    h = Rolling(data).ranges(at, at + GRAM)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = ((h >> bits) << bits) | at.astype(np.uint64)
    width, least = 1, low
    while 2 * width <= STARTS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = STARTS - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    start = np.arange(len(least))
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + SPAN <= offsets[text + 1]
    place = np.unique((least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    text = np.searchsorted(offsets, place, "right") - 1
    return text, place, h[place]


def packed(order: np.ndarray, head: np.ndarray, values: np.ndarray):
    """An Arrow column of a blob for each run of the ordered values; `head` marks where the runs start."""
    import pyarrow as pa

    ends = np.append(np.flatnonzero(head), len(order)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values[order]))]).cast(pa.binary())


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


def _anchors(bits: int, sinks: int):
    """By bucket of the hash: the anchors, hashes of their surroundings, documents, rows and places.

    Of the documents that a task finds with the same surroundings of an anchor
    only the first goes on; the others lose them, which is known at once and
    passes by in buckets below zero.
    """

    def run(batches):
        import pyarrow as pa

        def rows():
            h, k, m, r, p = (np.concatenate(x) for x in zip(*parts))
            high = np.uint64(64 - bits)
            order = np.argsort((h >> high << high) | (mix64(h ^ k) >> np.uint64(bits)) if bits else mix64(h ^ k), kind="stable")
            h, k, m, r, p = h[order], k[order], m[order], r[order], p[order]
            head = heads(h, k)
            least = np.minimum.reduceat(m, np.flatnonzero(head))[np.cumsum(head) - 1]
            gone = np.flatnonzero(m > least)
            if len(gone):
                x = gone[np.lexsort((r[gone], m[gone]))]
                head = heads(m[x], r[x])
                first = x[head]
                none = pa.nulls(len(first), pa.binary())
                sink = -1 - (mix64(m[first].view(np.uint64)) % np.uint64(sinks)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sink), none, none, none, none, none, pa.array(m[first]), pa.array(r[first]), packed(x, head, p)], names=NAMES)
            x = np.flatnonzero(m == least)
            bucket = (h[x] >> high).astype(np.int64) if bits else np.zeros(len(x), np.int64)
            head = heads(bucket)
            none, blank = pa.nulls(int(head.sum()), pa.int64()), pa.nulls(int(head.sum()), pa.binary())
            low = (h >> np.uint64(32 - bits)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[head]), *(packed(x, head, v) for v in (low, k, m, r, p)), none, none, blank], names=NAMES)

        parts, size = [], 0
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                for text, left, place, h, around in surrounded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    parts.append((h, around, ids[a + text], keys[a + text], place.astype(np.uint32)))
                    size += 32 * len(h)
                if size > GATHER:
                    yield from rows()
                    parts, size = [], 0
        if size:
            yield from rows()

    return run


NAMES = ["bucket", "h", "k", "m", "r", "p", "id", "row", "lost"]


def surrounded(data: np.ndarray, offsets: np.ndarray):
    """(text number, bytes before, place, hash, hash of the surroundings) of the anchors of texts laid end to end.

    A long text is read in parts whose windows follow each other; an anchor that
    windows of two parts choose comes twice.
    """
    n = len(data)
    step = n if len(offsets) > 2 or n <= 2 * SLICE_BYTES else SLICE_BYTES
    for start in range(0, max(1, n), max(1, step)):
        text, place, h = anchors(data[start : start + step + SPAN - 1] if step < n else data, offsets if step == n else np.array([0, min(step + SPAN - 1, n - start)]))
        place = place + start
        left, right = np.maximum(place - STARTS + 1, offsets[text]), np.minimum(place + SPAN, offsets[text + 1])
        low, high = (max(0, start - SPAN), min(n, start + step + 2 * SPAN)) if step < n else (0, n)
        around = mix64(Rolling(data[low:high]).ranges(left - low, right - low) + (place - left).astype(np.uint64))
        yield text, place - left, place - offsets[text], h, around


def _settle(key, rows):
    """By row: places whose surroundings an earlier document has, and all places and anchors of first surroundings beside others."""
    import pyarrow as pa

    if key[0].as_py() < 0:
        none = pa.nulls(len(rows), pa.binary())
        return pa.table([rows.column("id"), rows.column("row"), rows.column("lost"), none, none], names=["id", "row", "lost", "place", "anchor"])
    kinds = (("h", np.uint32), ("k", np.uint64), ("m", np.int64), ("r", np.int64), ("p", np.uint32))
    h, around, doc, row, place = (np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()]) for c, t in kinds)
    order = np.lexsort((place, row, doc, around, h))
    h, around, doc, row, place = h[order], around[order], doc[order], row[order], place[order]
    del order
    anchor = heads(h)
    group = anchor | heads(around)
    fresh = group | heads(doc, row, place)  # repeated rows have equal places
    least = doc[group][np.cumsum(group) - 1]
    lost = doc > least
    number = np.cumsum(anchor) - 1
    several = (np.bincount(number, group)[number] > 1) & (doc == least) & fresh  # the places of each group's first document
    low, high = (f.reduceat(least, np.flatnonzero(anchor))[number] for f in (np.minimum, np.maximum))
    several &= low < high
    del least, number, low, high, group, anchor, fresh, around
    out = []
    for what, part in ((lost, True), (several, False)):
        k = np.flatnonzero(what)
        k = k[np.lexsort((row[k], doc[k]))]
        head = heads(doc[k], row[k])
        ids, keys, places = pa.array(doc[k][head]), pa.array(row[k][head]), packed(k, head, place)
        none = pa.nulls(len(ids), pa.binary())
        full = None if part else h.astype(np.int64) | (np.int64(key[0].as_py()) << np.int64(32))
        out.append(pa.table([ids, keys, *([places, none, none] if part else [none, places, packed(k, head, full)])], names=["id", "row", "lost", "place", "anchor"]))
    return pa.concat_tables(out)


def _surroundings(batches):
    """(anchor, bytes around it, bytes before it, document, row, first byte's places) for the places asked for.

    Places of one document with the same surroundings come one after the other
    and are one row, as far as they lie in one part of the batch.
    """
    import pyarrow as pa

    for batch in batches:
        ids, keys = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        data, offsets = text_bytes(batch.column(1))
        places = [np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in batch.column(2).to_pylist()]
        found = np.concatenate([np.frombuffer(b"".join(x), np.int64) for x in batch.column(3).to_pylist()] or [np.zeros(0, np.int64)])
        text = np.repeat(np.arange(len(ids)), [len(x) for x in places])
        place = np.concatenate(places or [np.zeros(0, np.int64)]) + offsets[text]
        left, right = np.maximum(place - STARTS + 1, offsets[text]), np.minimum(place + SPAN, offsets[text + 1])
        for a in range(0, len(text), 50_000):
            x = slice(a, a + 50_000)
            size, lefts = right[x] - left[x], (left - offsets[text])[x].astype(np.uint32)
            same = np.zeros(len(size), bool)
            like = [y[x][1:] == y[x][:-1] for y in (text, found, place - left, right - place)]
            k = np.flatnonzero(np.logical_and.reduce(like)) + 1
            if len(k):
                equal = data[spread(left[x][k], size[k])] == data[spread(left[x][k - 1], size[k])]
                same[k] = np.logical_and.reduceat(equal, np.cumsum(size[k]) - size[k])
            head = np.flatnonzero(~same)
            size, ends = size[head], 4 * np.append(head, len(same))
            around = pa.Array.from_buffers(
                pa.binary(), len(head), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data[spread(left[x][head], size)])]
            )
            lefts = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(lefts)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[x][head]), around, pa.array((place - left)[x][head].astype(np.int32)), pa.array(ids[text[x][head]]), pa.array(keys[text[x][head]]), lefts],
                names=["anchor", "around", "before", "id", "row", "lefts"],
            )


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of s (integers of 1 or more) in order, by difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s, np.zeros(4, np.int64)])
    i12 = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    top = int(s.max()) + 1
    if top > 1 << 21:
        s, top = np.unique(s, return_inverse=True)[1].astype(np.int64), n + 1
    if top <= 1 << 20:
        name = np.unique((s[i12] * top + s[i12 + 1]) * top + s[i12 + 2], return_inverse=True)[1] + 1
    else:
        pair = np.unique(s[i12] * top + s[i12 + 1], return_inverse=True)[1]
        name = np.unique(pair * top + s[i12 + 2], return_inverse=True)[1] + 1
    if name.max() < len(i12):
        order = suffix_array(name.astype(np.int64))
    else:
        order = np.empty(len(i12), np.int64)
        order[name - 1] = np.arange(len(i12))
    rank = np.zeros(n + 4, np.int64)
    sa12 = i12[order]
    rank[sa12] = np.arange(1, len(sa12) + 1)
    sa12 = sa12[sa12 < n]
    most = len(i12) + 2
    i0 = np.arange(0, n, 3)
    sa0 = i0[np.argsort(s[i0] * most + rank[i0 + 1], kind="stable")]
    one, two = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    before = np.searchsorted(s[one] * most + rank[one + 1], s[sa0] * most + rank[sa0 + 1])
    pairs = np.unique(np.concatenate([s[two] * top + s[two + 1], s[sa0] * top + s[sa0 + 1]]), return_inverse=True)[1].astype(np.int64)
    before += np.searchsorted(pairs[: len(two)] * most + rank[two + 2], pairs[len(two) :] * most + rank[sa0 + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(sa0))
    out[at] = sa0
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sa12
    return out


def least_owner(texts: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, least owner) for every string of SPAN bytes in the texts that several of them have."""
    size = np.array([len(x) for x in texts], np.int64)
    first = np.cumsum(size + 1) - size - 1
    data = np.zeros(int((size + 1).sum()) + SPAN, np.uint8)
    data[spread(first, size)] = np.frombuffer(b"".join(texts), np.uint8)
    letters = data.astype(np.int64) + 2
    letters[first + size] = 1  # the ends
    order = suffix_array(letters[: int((size + 1).sum())])
    text = np.searchsorted(first, order, "right") - 1
    start = order - first[text]
    whole = start + SPAN <= size[text]
    order, text, start = order[whole], text[whole], start[whole]
    if not len(order):
        return text, start, order
    windows = np.lib.stride_tricks.sliding_window_view(data, SPAN)
    same = np.zeros(len(order) - 1, bool)
    for a in range(0, len(same), 65536):
        b = min(a + 65536, len(same))
        same[a:b] = (windows[order[a:b]] == windows[order[a + 1 : b + 1]]).all(axis=1)
    head = np.concatenate([[True], ~same])
    run = np.cumsum(head) - 1
    least = np.minimum.reduceat(owner[text], np.flatnonzero(head))[run]
    several = np.bincount(run)[run] > 1
    return text[several], start[several], least[several]


def may_match(anchor: np.ndarray, around: list[bytes], before: np.ndarray) -> np.ndarray:
    """Whether another surrounding of the anchor has the same half-way bytes before or after it, as a match needs."""
    half = STARTS // 2
    size = np.array([len(x) for x in around])
    data = np.frombuffer(b"".join(around), np.uint8)
    at = np.cumsum(size) - size + before
    roll, out = Rolling(data), np.zeros(len(around), bool)
    ends = np.cumsum(size)
    for ok, a, b in ((before >= half, at - half, at), (ends - at - GRAM >= half, at + GRAM, at + GRAM + half)):
        k = np.flatnonzero(ok)
        _, inverse, many = np.unique(roll.ranges(a[k], b[k]) ^ anchor[k].astype(np.uint64), return_inverse=True, return_counts=True)
        out[k] |= many[inverse] > 1
    return out


def everywhere(text: np.ndarray, start: np.ndarray, lefts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of strings that start so far into surroundings, at all places of these, each once and in order."""
    many = np.array([len(x) // 4 for x in lefts], np.int64)
    out, ends, a = [(text[:0], start[:0])], np.cumsum(many), 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SORTED)))
        t, s = np.repeat(text[a:b], many[a:b]), np.repeat(start[a:b], many[a:b])
        s += np.frombuffer(b"".join(lefts[a:b]), np.uint32)
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        first = heads(t, s)
        out.append((t[first], s[first]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out))


def _sort(key, rows):
    """By row: the starts of strings in a bucket's surroundings that an earlier document has."""
    import pyarrow as pa

    rows = rows.sort_by([("anchor", "ascending"), ("id", "ascending"), ("row", "ascending")])
    anchor, before, owner, row = (rows.column(c).to_numpy() for c in ("anchor", "before", "id", "row"))
    around, lefts = rows.column("around").to_pylist(), rows.column("lefts").to_pylist()
    del rows
    keep = np.flatnonzero(may_match(anchor, around, before)) if around else np.zeros(0, np.int64)
    done = np.cumsum([len(around[k]) for k in keep])
    _, first, number = np.unique(np.stack([owner, row], 1), axis=0, return_index=True, return_inverse=True)
    number = number.ravel()
    found, a = [(number[:0], number[:0])], 0
    while a < len(keep):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + SORTED)))
        while b < len(keep) and anchor[keep[b]] == anchor[keep[b - 1]]:
            b += 1
        part = keep[a:b]
        text, start, least = least_owner([around[k] for k in part], owner[part])
        less = least < owner[part][text]
        found.append(everywhere(number[part][text[less]], start[less], [lefts[k] for k in part[text[less]]]))
        a = b
    who, starts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(who, kind="stable")
    head = heads(who[order])
    at = first[who[order][head]]
    return pa.table({"id": pa.array(owner[at]), "row": pa.array(row[at]), "starts": packed(order, head, starts.astype(np.uint32))})


def runs_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs (from, to) that ranges cover."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    head = np.concatenate([[True], a[1:] > b[:-1]])
    return a[head], b[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(b) - 1]])]


def whole_characters(raw: bytes, kept: np.ndarray) -> bytes:
    """The kept bytes without those of characters that a run of them holds in part."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
    return b"".join(raw[a:b].decode("utf-8", "ignore").encode() for a, b in zip(edge[::2], edge[1::2]))


def _cut(batches, whole: bool = False):
    """(id, n_bytes, n_removed, n_spans, kept bytes) from text, places of lost surroundings, and starts of lost strings."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        out = []
        for i, (lost, starts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            raw = data[offsets[i] : offsets[i + 1]]
            if not lost and not starts:
                out.append((len(raw), 0, 0, raw.tobytes()))
                continue
            p, s = (np.frombuffer(b"".join(x or []), np.uint32).astype(np.int64) for x in (lost, starts))
            a, b = runs_of(np.concatenate([np.maximum(p - STARTS + 1, 0), s]), np.concatenate([np.minimum(p + SPAN, len(raw)), s + SPAN]))
            gone = np.zeros(len(raw) + 1, np.int8)
            gone[a], gone[b] = 1, -1
            stays = np.cumsum(gone[:-1]) == 0
            out.append((len(raw), int((b - a).sum()), len(a), whole_characters(raw.tobytes(), stays) if whole else raw[stays].tobytes()))
        n, removed, spans, kept = zip(*out) if out else ((), (), (), ())
        more = batch.schema.names[4:]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), *batch.columns[4:]],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept", *more],
        )


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False, carry: tuple = ()) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept binary): every whole text without its repeated passages.

    Passages are cut by bytes; with `whole`, kept is also without what is left of
    characters that a cut parts, and n_removed still counts the passages alone.
    Columns to `carry` along follow as c0, c1, ..
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "suffix")
    others = [f"c{i}" for i in range(len(carry))]
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), *[F.col(c).alias(o) for c, o in zip(carry, others)])
    hashed = texts.filter("id is not null").select("id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))
    sums = scratch.write(hashed.groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.sum("size").alias("size")), "sums")
    total = sums.agg(F.sum("size")).first()[0] or 0
    twins = scratch.write(sums.filter("low <> high").select("id", F.lit(True).alias("twin")), "twins")
    # rows are told apart by their text's hash where a key has several texts, and only there
    if twins.isEmpty():
        texts = texts.withColumn("row", F.lit(0).cast("bigint"))
    else:
        texts = texts.join(twins, "id", "left").withColumn("row", F.when(F.col("twin"), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint"))).drop("twin")
    keyed = texts.filter("id is not null").select("id", "text", "row")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(least - 1, int(total * 2 / (STARTS + 1) / BUCKET)).bit_length()

    kinds = "bucket bigint, h binary, k binary, m binary, r binary, p binary, id bigint, row bigint, lost binary"
    found = keyed.mapInArrow(lean(_anchors(bits, 4 << bits)), kinds).groupBy("bucket")
    settled = scratch.write(found.applyInArrow(_settle, "id bigint, row bigint, lost binary, place binary, anchor binary"), "settled")
    del found
    scratch.release()
    asked = settled.filter("place is not null").groupBy("id", "row").agg(F.collect_list("place").alias("place"), F.collect_list("anchor").alias("anchor"))
    asked = scratch.write(asked, "asked")
    around = keyed.join(asked, ["id", "row"]).select("id", "text", "place", "anchor", "row")
    around = scratch.write(around.mapInArrow(lean(_surroundings), "anchor bigint, around binary, before int, id bigint, row bigint, lefts binary"), "around")
    scratch.drop(asked)
    del asked
    scratch.release()

    crowds = scratch.write(around.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD), "crowds")
    crowded = not crowds.isEmpty()
    usual = around.join(crowds, "anchor", "left_anti") if crowded else around
    buckets = max(least, int(around.count() * SPAN / (8 * SORTED)))
    repeats = usual.withColumn("bucket", F.pmod(F.hash("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(_sort, "id bigint, row bigint, starts binary")
    repeats = repeats.groupBy("id", "row").agg(F.collect_list("starts").alias("starts"))
    if crowded:  # anchors in very many surroundings: their strings are counted one by one
        strings = around.join(crowds, "anchor").filter(f"length(around) >= {SPAN}")
        strings = strings.withColumn("s", F.explode(F.expr(f"sequence(0, length(around) - {SPAN})")))
        strings = strings.select("id", "row", F.struct("s", "lefts").alias("at"), F.expr(f"substring(around, s + 1, {SPAN})").alias("string"))
        lowest = scratch.write(strings.groupBy("string").agg(F.min("id").alias("low")), "lowest")
        more = strings.join(lowest, "string").filter("low < id").groupBy("id", "row").agg(F.collect_list("at").alias("all"))
        more = more.mapInArrow(_packed, "id bigint, row bigint, starts array<binary>")
        repeats = repeats.unionByName(more).groupBy("id", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    lost = settled.filter("lost is not null").groupBy("id", "row").agg(F.collect_list("lost").alias("lost"))
    state = scratch.write(lost.join(repeats, ["id", "row"], "full"), "state")
    scratch.drop(around)
    scratch.drop(settled)
    scratch.release()
    kinds = ", ".join(["id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", *(f"{o} {texts.schema[o].dataType.simpleString()}" for o in others)])
    out = texts.join(state, ["id", "row"], "left").select("id", "text", "lost", "starts", *others)
    return out.mapInArrow(lean(partial(_cut, whole=whole)), kinds).withColumnRenamed("id", key)


def _packed(batches):
    """Lists of (start inside surroundings, places of these) as one blob of starts each."""
    import pyarrow as pa

    for batch in batches:
        blobs = []
        for x in batch.column(2).to_pylist():
            s = np.array([y["s"] for y in x], np.int64)
            blobs.append([np.unique(everywhere(np.zeros_like(s), s, [y["lefts"] for y in x])[1]).astype(np.uint32).tobytes()])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.list_(pa.binary()))], names=["id", "row", "starts"])
