"""Where to read: byte ranges of samples, their coalescing, and look-ups in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr

#: Sampling of extraction: seed, blocks, block length, rows of a sketch, spectral values, layer stride; gap of coalescing (fixed values).
SEED, BLOCKS, BLOCK_LEN, SKETCH_ROWS, TOP_K, STRIDE, GAP = 20260704, 32, 16384, 192, 32, 4, 65536


def sample_plan(tensors: DataFrame, blocks: int = BLOCKS, block_len: int = BLOCK_LEN) -> DataFrame:
    """(tensor columns.., block_no, elem_offset, n_elems, byte_start, byte_end): whole tensors, or seeded blocks of large ones.

    Needs numel, itemsize, start (first byte) and seed.
    """
    whole = F.col("numel") <= blocks * block_len
    drawn = expr.lcg_offsets(F.col("numel"), F.lit(blocks), F.lit(block_len).cast("bigint"), F.col("seed"))
    offsets = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(drawn)
    out = tensors.select("*", F.posexplode_outer(offsets).alias("block_no", "elem_offset"))
    out = out.withColumn("n_elems", F.when(whole, F.col("numel")).otherwise(F.lit(block_len)).cast("bigint"))
    first = F.col("start") + F.col("elem_offset") * F.col("itemsize")
    return out.withColumn("byte_start", first).withColumn("byte_end", first + F.col("n_elems") * F.col("itemsize"))


def seeded_sample(plan: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Elements (keys.., pos, value) that a plan reads, in block order: a range join inside each tensor."""
    p = plan.select(*keys, "block_no", "elem_offset", "n_elems")
    hit = (F.col("pos") >= F.col("elem_offset")) & (F.col("pos") < F.col("elem_offset") + F.col("n_elems"))
    return elements.join(p, keys).filter(hit).select(*keys, "block_no", "pos", "value")


def islands(ranges: DataFrame, group: list[str], start: str = "byte_start", end: str = "byte_end", gap: int = GAP) -> DataFrame:
    """Ranges with the number of their island: a range that starts at most `gap` after the furthest end so far belongs to the one before."""
    order = Window.partitionBy(*group).orderBy(start, end)
    furthest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.withColumn("_new", F.when(F.col(start) - furthest <= gap, 0).otherwise(1))
    return fresh.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def coalesce_ranges(ranges: DataFrame, group: list[str], start: str = "byte_start", end: str = "byte_end", gap: int = GAP) -> DataFrame:
    """Ranges merged by their islands."""
    found = islands(ranges, group, start, end, gap)
    return found.groupBy(*group, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_ranges")).drop("island")


def range_lookup(wanted: DataFrame, blobs: DataFrame, group: list[str], start: str = "byte_start", end: str = "byte_end") -> DataFrame:
    """Wanted ranges with the blob that holds them whole, if any: the last blob that starts at or before, found by one sort.

    Blobs don't overlap, so that blob is the only one that can hold the range.
    """
    b = blobs.select(*group, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(start).alias("s"), F.col(end).alias("e")).alias("_blob"), F.lit(None).cast("bigint").alias(end))
    w = wanted.select(*group, F.col(start).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(b.schema["_blob"].dataType).alias("_blob"), F.col(end).cast("bigint").alias(end))
    order = Window.partitionBy(*group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = b.unionByName(w).withColumn("_last", F.last("_blob", ignorenulls=True).over(order)).filter("_kind = 1")
    held = F.col("_last.e") >= F.col(end)
    return seen.select(*group, F.col("_at").alias(start), end, F.when(held, F.col("_last.s")).alias("blob_start"), F.when(held, F.col("_last.e")).alias("blob_end"))


def block_span(segments: DataFrame, block_elems: str = "block_elems", start: str = "elem_start", n: str = "n_elems") -> DataFrame:
    """The whole quantisation blocks that cover a run of elements, and the elements to skip in the first."""
    first = F.floor(F.col(start) / F.col(block_elems))
    last = F.ceil((F.col(start) + F.col(n)) / F.col(block_elems))
    return segments.withColumn("first_block", first).withColumn("n_blocks", last - first).withColumn("skip", F.col(start) - first * F.col(block_elems))


def unpermuted_row(row, rows, heads):
    """The stored row of a logical row where a converter interleaved the two halves of each head."""
    size = (rows / heads).cast("bigint")
    head, inside = F.floor(row / size), row % size
    half = (size / 2).cast("bigint")
    return (head * size + 2 * (inside % half) + F.floor(inside / half)).cast("bigint")


def sketch_band(rows, seed):
    """First row of the seeded band of at most SKETCH_ROWS rows."""
    band = F.least(rows, F.lit(SKETCH_ROWS))
    width = (rows - band + 1).cast("decimal(20,0)")
    return F.when(rows > band, (seed.cast("decimal(20,0)") % width).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
