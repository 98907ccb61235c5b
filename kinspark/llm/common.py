"""Helpers shared by the corpus operators: scratch tables, Arrow byte views, components."""

from __future__ import annotations

import atexit
import contextlib
import sys
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python; texts average a few KB, so a batch stays a few MB.
ARROW_ROWS = 1000
#: Bytes of text worked on at once inside a Python worker.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker and survives between its tasks."""
    return sys.modules.setdefault("_kinspark_cache", types.ModuleType("_kinspark_cache")).__dict__


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for workers with little memory; never raises the setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def lean(run):
    """A function over Arrow batches that gives unused memory back to the system when its task ends.

    Workers wait for the next task with what their allocators keep, beside those that work.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trimmed = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trimmed:
        trimmed(0)


#: Bytes of a heap, an executor's or the driver's, up to which plans leave it tidied.
SMALL_HEAP = 4 << 30


def small_heap(spark: SparkSession) -> bool:
    """Whether executors are processes of their own with a heap of SMALL_HEAP or less."""
    size = spark.conf.get("spark.executor.memory", "1g").strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(size[-1:], 0)
    number = size[:-1] if unit else size
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    return not local and number.isdigit() and int(number) << (unit or 20) <= SMALL_HEAP


def trim_driver(spark: SparkSession) -> None:
    """Collect the garbage of the driver's JVM; one of SMALL_HEAP or less gives what it then doesn't use back to the system.

    Its heap would else stay as large as any plan has made it, and its native
    allocators, of which each of hundreds of threads has a part, too.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def manage(bean: str, *call: str) -> None:
        with contextlib.suppress(Exception):  # JVMs differ in what they can do
            kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
            invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
            name = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}")
            given = [name, call[0], array(jvm.Object, *call[1:]), array(jvm.String, *["java.lang.String"] * (len(call) - 1))]
            invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, *given))

    lean = jvm.Runtime.getRuntime().maxMemory() <= SMALL_HEAP
    if lean:
        manage("HotSpotDiagnostic", "setVMOption", "MinHeapFreeRatio", "10")
        manage("HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", "30")
    jvm.System.gc()
    if lean:
        manage("DiagnosticCommand", "systemTrimNativeHeap")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors.

    What is not dropped before stays until the driver ends, as results may still
    read it, and is then deleted.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        atexit.register(self.close)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:  # the session may have ended before
                self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.made):03d}-{name}"
        df.write.parquet(path)
        self.made.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = getattr(df, "scratch_path", None)
        if path:
            self._delete(path)

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that are finished, and small executors give heap back, before the next plans come.

        Executors share their memory with Python workers; one of SMALL_HEAP or
        less keeps what earlier plans needed where the workers then lack it.
        """
        import time

        tasks = self.spark.sparkContext.defaultParallelism
        if small_heap(self.spark) and tasks <= 64:
            self.spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()
        for _ in range(2):  # the driver's JVM lets go of a plan some time after Python has
            trim()
            trim_driver(self.spark)
            time.sleep(0.2)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of an Arrow string or binary column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """Ranges of rows of about `size` bytes each; a longer text has a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def cut_at(data: np.ndarray, apart: np.ndarray, size: int = SLICE_BYTES):
    """Ranges of a long text of about `size` bytes each that end before a byte of the kind `apart`."""
    start = 0
    while start < len(data):
        end = start + size
        while end < len(data):
            found = np.flatnonzero(apart[data[end : end + size]])
            if len(found):
                end += int(found[0])
                break
            end += size
        yield start, min(end, len(data))
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those of a slice's length are remembered."""
    known, size = process_cache(), 2 * SLICE_BYTES
    if n <= size and ("powers", base) in known:
        return known["powers", base][: max(n, 1)]
    out = np.full(size if n <= size else n, base, np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    if n <= size:
        known["powers", base] = out
    return out[: max(n, 1)]


#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes of byte strings.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class Rolling:
    """Hashes of any byte range of `data` in constant time each, polynomial modulo 2**64, then mixed."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.down = powers(BASE_INVERSE, n + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n) if n else np.zeros(0, np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


#: Edges up to which components are found on the driver, 16 bytes each.
FEW_EDGES = 100_000


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (a, b): rows (id, component), component the smallest id.

    FEW_EDGES or less are gathered, as dozens of plans for them would only cost
    the driver time and memory.  More go through alternating large-star and
    small-star rounds over DataFrames.  Every round is a written table; no
    node's neighbours are ever gathered in one row, and only a checksum comes to
    the driver.  Self links and repeats are harmless; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e, last = scratch.write(e, "edges"), None
    if e.count() <= FEW_EDGES:
        import pyarrow as pa

        few = e.toArrow()
        scratch.drop(e)
        found = few_components(*(few.column(c).to_numpy() for c in "uv"))
        return scratch.spark.createDataFrame(pa.table([pa.array(x, few.schema.field("u").type) for x in found], ["id", "component"]))
    while True:
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == last:
            break
        last = tuple(sign)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = scratch.write(small, "small")
        scratch.drop(e)
        scratch.drop(large)
        e = after
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def few_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, in order, and the smallest node that each reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while (low[a] != low[b]).any():
        x, y = low[a], low[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    return ids, ids[low]


class HashIndex:
    """Positions of uint64 keys in an open-addressing table, for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.value[at] < 0
            put, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.keys[put], self.value[put] = keys[who], who
            stay = self.value[at] != left
            stay &= ~((self.keys[at] == keys[left]) & (self.value[at] >= 0))
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key among those indexed, -1 where it is not one of them."""
        at = self._slot(keys)
        out = self.value[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.value[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, .. start+length-1 of every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


#: Groups that a sample takes rows of at most, the largest of them.
GROUPS = 1000


def labelled_sample(df: DataFrame, key: str, group: str, rows: int, text: str | None = None, size: int = 0) -> DataFrame:
    """About `rows` rows and, given a text, about `size` bytes of it, of each of the GROUPS largest groups, chosen by a hash of the key.

    Works at any size of the table: one aggregate counts the groups, and each
    row is then kept by 62 bits of its own hash, so no group meets in one task
    and no share is too small.
    """
    weight = F.sum(F.octet_length(text).cast("bigint")) if text else F.lit(0)
    counts = df.groupBy(group).agg(F.count("*").alias("n"), weight.alias("b")).orderBy(F.desc("n"), group).limit(GROUPS).collect()
    share = F.lit(0).cast("bigint")
    for c in counts:
        part = min(1.0, rows / max(1, c["n"]), size / max(1, c["b"]) if text and c["b"] else 1.0)
        share = F.when(F.col(group).eqNullSafe(F.lit(c[group])), F.lit(max(1, int(part * 2**62)))).otherwise(share)
    return df.filter(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 2) < share)


def bounded_sample(scratch: Scratch, df: DataFrame, key: str, group: str, text: str, rows: int, size: int):
    """An Arrow table of a bounded sample's columns, in the order of the keys: of each group `rows` rows and `size` bytes of text at most.

    The rows come from a sample of about that size, in the order of a second
    hash, as long as their bytes fit; a text that alone has more is left out.
    """
    from pyspark.sql import Window

    order = F.xxhash64(F.lit("rank"), key)
    held = scratch.write(labelled_sample(df, key, group, rows, text, size), "sample")
    fits = held.select(key, group, F.octet_length(text).cast("bigint").alias("bytes")).filter(F.col("bytes") <= size)
    before = Window.partitionBy(group).orderBy(order, key)  # over keys and lengths of the sample alone
    fits = fits.withColumn("sum", F.sum("bytes").over(before.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(before))
    fits = scratch.write(fits.filter((F.col("sum") <= size) & (F.col("nth") <= rows)).select(key).distinct(), "fits")
    out = held.join(F.broadcast(fits), key).filter(F.octet_length(text) <= size).dropDuplicates([key]).toArrow().sort_by(key)
    scratch.drop(held)
    scratch.drop(fits)
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, size: int):
    """An Arrow table (k, x, y) of a bounded sample of texts with a label of 0 or 1, in the order of their keys.

    The labels are sampled before they meet the texts, so that the texts are
    read once and don't move; of each label it has `rows` rows and `size` bytes
    at most.  Where a key has several labels the largest counts, where it has
    several texts one of them.
    """
    scratch = Scratch(docs.sparkSession, "sample")
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and k is not null")
    marks = scratch.write(labelled_sample(marks.groupBy("k").agg(F.max("y").alias("y")), "k", "y", rows), "marks")  # about 2 * rows: may be broadcast
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("x")).join(F.broadcast(marks), "k")
    texts = scratch.write(texts.select("k", "x", "y"), "texts")
    out = bounded_sample(scratch, texts, "k", "y", "x", rows, size)
    scratch.drop(marks)
    scratch.drop(texts)
    return out
