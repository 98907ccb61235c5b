"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class from the start.  A pass gives every class a key, the
signs of BITS random projections laid end to end, sorts the classes by it and
compares each with the WINDOW before it; pairs of cosine THRESHOLD or more join
their classes.  Every pass has projections of its own.  A pass also tells for
each class from how many leading bits on all keys that share them with its own
lie inside the window; the most of them over a round's passes bounds the chance
that a neighbour at the threshold was missed, however the vectors lie (a pass
where a range border cuts the window counts for nothing).  Classes with a chance
of less than 1 - CERTAINTY are done.  Rounds of passes go on among the others,
each with twice the window, and when FEW are left, or the window would pass
WIDEST, all pairs of these are compared.  The union gives the components.  Inside a component
every pair is then compared, tile by tile, so that the number of links is exact
whatever the windows held; no pair leaves a tile.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing and are components of their own, as are vectors
that only others of another length resemble; repeated rows are vectors of their
own, equal to each other; ties don't matter; extra columns are left out; an
empty table gives an empty table.  A pair that one
pass parts is left to the others.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, process_cache

THRESHOLD, BITS, WINDOW, CERTAINTY = 0.95, 60, 128, 0.999
#: Most members of a component on each side of a tile.
TILE = 512
#: Classes left from which on passes go on; widest window; classes on each side of a tile of those left.
FEW, WIDEST, SIDE = 16_384, 4096, 1024
#: Classes of one range of a pass at most, where there are more than the session's tasks hold.
RANGE = 100_000


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW) -> int:
    """Passes of the first round: those after which a pair at the threshold has met with probability CERTAINTY, if vectors lie evenly."""
    bits = max(1.0, math.log2(max(2, n) / window))
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - CERTAINTY) / math.log(1 - min(met, 0.99))))


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as unit rows in double precision."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_length(batch, column: int):
    """Parts of a batch whose lists are equally long."""
    import pyarrow as pa

    size = batch.column(column).value_lengths().to_numpy()
    for n in np.unique(size):
        yield int(n), batch.filter(pa.array(size == n))


def _keys(passes: int, turn: int):
    def run(batches):
        import pyarrow as pa

        cache = process_cache()
        for batch in batches:
            for n, part in by_length(batch, 1):
                if ("planes", n, passes, turn) not in cache:
                    cache["planes", n, passes, turn] = np.random.default_rng([n, passes, turn]).normal(size=(n, passes * BITS))
                signs = (matrix(part.column(1)) @ cache["planes", n, passes, turn] > 0).reshape(part.num_rows, passes, BITS)
                keys = (signs.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, passes, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "vector", "keys"])

    return run


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number of its group for each of n, given pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading ones of their BITS bits two keys share."""
    x, half = a ^ b, BITS // 2
    high, low = x >> half, x & ((1 << half) - 1)
    return BITS - np.where(high > 0, half + np.frexp(high.astype(float))[1], np.frexp(low.astype(float))[1])


def needed_bits(keys: np.ndarray, window: int) -> np.ndarray:
    """Leading bits such that all keys that share them with one of a partition's sorted keys lie in its window; 0 where the border cuts it."""
    at = np.arange(len(keys))
    low, high = at - window - 1, at + window + 1
    inside = [shared_bits(keys, keys[np.clip(k, 0, len(keys) - 1)]) for k in (low, high)]
    beyond = [(low < 0), (high >= len(keys))]
    bits = np.maximum(*[np.where(x, 0, y) for x, y in zip(beyond, inside)]) + 1
    border = np.maximum(*[np.where(x, y, 0) for x, y in zip(beyond, inside)]) + 1  # keys past the border share no more
    return np.where(border > bits, 0, bits)


def _window(threshold: float, window: int):
    """Rows (a, b, null) of joined classes, and (a, null, needed bits) of every class that no border cuts off."""

    def run(batches):
        import pyarrow as pa

        carried: dict[int, tuple] = {}
        seen: dict[int, list] = {}
        for batch in batches:
            for n, part in by_length(batch, 1):
                for i in range(0, part.num_rows, 1024):
                    some = part.slice(i, 1024)
                    ids, rows = some.column(0).to_numpy(), matrix(some.column(1))
                    seen.setdefault(n, []).append((ids, some.column(2).to_numpy()))
                    old_ids, old = carried.get(n, (ids[:0], rows[:0]))
                    ids, rows = np.concatenate([old_ids, ids]), np.concatenate([old, rows])
                    old = len(old)
                    near = rows[old:] @ rows.T >= threshold
                    b, a = np.nonzero(np.tril(near, old - 1) & ~np.tril(near, old - window - 1))
                    b += old
                    label = joined(a, b, len(ids))
                    moved = np.flatnonzero(label != np.arange(len(ids)))
                    if len(moved):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]]), pa.nulls(len(moved), pa.int32())], names=["a", "b", "bits"])
                    carried[n] = ids[-window:], rows[-window:]
        for parts in seen.values():
            ids, keys = (np.concatenate(x) for x in zip(*parts))
            bits = needed_bits(keys, window).astype(np.int32)
            ids, bits = ids[bits > 0], bits[bits > 0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(bits)], names=["a", "b", "bits"])

    return run


def _pairs(threshold: float):
    """Joined classes of a tile, whose rows are all compared."""

    def run(key, rows):
        import pyarrow as pa

        lists, ids = rows.column("vector").combine_chunks(), rows.column("id").to_numpy()
        size, out = lists.value_lengths().to_numpy(), [(ids[:0], ids[:0])]
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            unit = matrix(lists.take(pa.array(at)))
            b, a = np.nonzero(np.tril(unit @ unit.T >= threshold, -1))
            label = joined(a, b, len(at))
            moved = np.flatnonzero(label != np.arange(len(at)))
            out.append((ids[at[moved]], ids[at[label[moved]]]))
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.table({"a": a, "b": b})

    return run


def linked(scratch: Scratch, own: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b) that join the classes (id, vector) of each component."""
    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    kind = own.schema["vector"].dataType.simpleString()
    left, n, turn, window, edges, state = own.select("id", "vector"), own.count(), 0, WINDOW, None, None
    passes, kept = passes_for(n, threshold), 1 - math.acos(threshold) / math.pi
    while True:
        keyed = scratch.write(left.mapInArrow(_keys(passes, turn), f"id bigint, vector {kind}, keys array<bigint>"), "keyed")
        met, parts = None, max(1, min(max(tasks, n // RANGE), n // (16 * window)))  # grows with the table
        for p in range(passes):
            part = keyed.select("id", "vector", F.element_at("keys", p + 1).alias("k")).repartitionByRange(parts, "k", "id").sortWithinPartitions("k", "id")
            found = part.mapInArrow(_window(threshold, window), "a bigint, b bigint, bits int")
            met = found if met is None else met.unionByName(found)
        met = scratch.write(met, "met")
        scratch.drop(keyed)
        found = met.filter("b is not null").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        miss = F.count("bits") * F.log1p(-F.least(F.pow(F.lit(kept), F.max("bits")), F.lit(1 - 1e-9)))
        chance = met.filter("b is null").groupBy(F.col("a").alias("id")).agg(miss.alias("miss"))
        chance = left.join(chance, "id", "left").withColumn("miss", F.coalesce("miss", F.lit(0.0)))
        if state is not None:
            chance = chance.join(state.select("id", F.col("miss").alias("before")), "id").withColumn("miss", F.col("miss") + F.col("before")).drop("before")
        state = scratch.write(chance.filter(F.col("miss") > math.log(1 - CERTAINTY)), "open")
        left, n, turn, window = state.select("id", "vector"), state.count(), turn + 1, 2 * window
        if n <= FEW or window > WIDEST:
            break
    if n:
        parts = math.ceil(n / SIDE)
        tiles = left.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        tiles = tiles.select(F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "id", "vector")
        edges = edges.unionByName(tiles.groupBy("p", "q").applyInArrow(_pairs(threshold), "a bigint, b bigint"))
    return scratch.write(edges.distinct(), "edges")


def _tile(threshold: float):
    def run(key, rows):
        import pyarrow as pa

        ids, side, many = (rows.column(c).to_numpy() for c in ("id", "side", "many"))
        lists = rows.column("vector").combine_chunks()
        size, links, unit = lists.value_lengths().to_numpy(), np.zeros(len(ids), np.int64), None
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            unit = matrix(lists.take(pa.array(at)))
            one = side[at] == 0
            same = not (~one).any()
            near = unit[one] @ (unit[one] if same else unit[~one]).T >= threshold
            if same:
                np.fill_diagonal(near, False)
                links[at] += near @ many[at]
            else:
                links[at[one]] += near @ many[at[~one]]
                links[at[~one]] += near.T @ many[at[one]]
        return pa.table({"id": ids, "links": links})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, n_links, component_id): the links of each vector and the smallest key of its component."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("vector")
    good = v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).alias("id"), F.col(column).alias("vector"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.reverse("vector")))
    usable = rows.filter("good and id is not null")
    classes = scratch.write(usable.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("many")), "classes")
    member = rows.join(classes, ["h1", "h2"], "left")
    member = member.select("id", F.when(F.col("good"), F.col("rep")).alias("rep"), F.when(F.col("good"), F.col("many")).alias("many"), "vector")
    member = scratch.write(member, "members")
    own = member.filter("id = rep").dropDuplicates(["id"]).select("id", "many", "vector")
    edges = linked(scratch, own, threshold)
    groups = scratch.write(components(scratch, edges), "groups")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    placed = groups.join(sizes, "component").join(own, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    tiles = placed.withColumn("other", F.explode(F.expr("sequence(0, cast(parts as int) - 1)"))).select(
        "component", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).cast("int").alias("side"), "id", "many", "vector"
    )
    links = tiles.groupBy("component", "p", "q").applyInArrow(_tile(threshold), "id bigint, links bigint")
    links = scratch.write(links.groupBy("id").agg(F.sum("links").alias("links")).join(groups, "id"), "links")
    out = member.select("id", "rep", "many").join(links.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select(
        F.col("id").alias(key),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("many") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component_id"),
    )
