"""From a checkpoint to the fingerprint tables of `compare`: catalog, signature, planned reads, aggregates.

Every byte range that a fingerprint needs follows from the catalog alone, so the
plan is a table: seeded blocks of the matrices, whole vectors, and the seeded
bands of rows behind the spectra.  Runs of elements become runs of whole blocks
as they are stored, those become few reads, and each read is one row of an Arrow
function that opens the file, reads once and cuts the runs out.  `bytes_read`
tells what a plan reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, names
from ..sources import files, tensors
from . import fingerprint, sampling

#: Most elements that one row of a read holds; a larger run is cut.
RUN = 1 << 20
#: Names of the fields of a model's shape, as configurations have them; those that two models must share come first (fixed values).
SHAPE = ["hidden_size", "num_hidden_layers", "num_attention_heads", "num_key_value_heads", "intermediate_size"]
CONFIG = [*SHAPE, "vocab_size"]
#: Roles with positional samples besides attention (fixed values).
ANCHORS = ["mlp.down", "mlp.fc2"]


def mapped(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    """The catalog of a checkpoint with layer and role; a name in two shards is an error."""
    tensors.register(spark)
    cat = spark.read.format("tensors").option("path", path).load().withColumn("model", F.lit(model_id)).withColumn("c", names.canonical("tensor"))
    twice = cat.groupBy("tensor").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{path}: a tensor is in two shards")
    return cat.select("*", "c.layer", "c.role").drop("c")


def side_file(path: str, name: str) -> str | None:
    """The text of a small file beside the weights; None if there is none."""
    folder = path.rsplit("/", 1)[0] if path.endswith((".safetensors", ".gguf", ".json")) else path
    return files.read_text(f"{folder.rstrip('/')}/{name}")


def signature(cat: DataFrame, path: str | None = None) -> DataFrame:
    """(model, n_layers, the other fields of SHAPE and vocab_size, n_params, inventory, coverage, dtype) of a mapped catalog.

    config.json beside the weights says the shape; what a quantised file says of
    itself wins over it; depth falls back on the names of the tensors, key-value
    heads on the heads.  A config that is no JSON object counts as empty.
    """
    line = F.concat_ws("|", "tensor", "dtype", F.array_join(F.col("shape").cast("array<string>"), ","))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("tensor", line.alias("line")))), lambda s: s["line"])
    known = F.count("role") / F.count("*")
    matrix = F.when(F.size("shape") == 2, F.col("dtype"))
    out = cat.groupBy("model").agg(
        F.coalesce(F.max("layer") + 1, F.lit(0)).alias("depth"), F.sum("numel").alias("n_params"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("inventory"), F.round(known, 4).alias("coverage"), F.coalesce(F.mode(matrix), F.mode("dtype")).alias("dtype"),
    )
    config = (side_file(path, "config.json") if path else None) or "{}"
    own = next((tensors.stored_config(s) for s in tensors.shards(path) if s.lower().endswith(".gguf")), {}) if path else {}
    kind = "struct<" + ", ".join(f"{c}: bigint" for c in CONFIG) + ", torch_dtype: string>"
    out = out.withColumn("config", F.from_json(F.lit(config), kind))

    def field(name: str) -> Column:
        stored = own.get(name)
        return F.lit(stored).cast("bigint") if stored else F.nullif(F.col(f"config.{name}"), F.lit(0))

    fields = {c: F.coalesce(field(c), F.lit(0).cast("bigint")) for c in CONFIG}
    fields["num_hidden_layers"] = F.coalesce(field("num_hidden_layers"), F.col("depth")).cast("bigint")
    fields["num_key_value_heads"] = F.coalesce(field("num_key_value_heads"), fields["num_attention_heads"])
    said = F.lit(own["torch_dtype"]) if own.get("torch_dtype") else F.coalesce(F.nullif(F.col("config.torch_dtype"), F.lit("")), F.lower("dtype"))
    return out.select("model", F.col("depth").cast("int").alias("n_layers"), *[c.alias(n) for n, c in fields.items()], "n_params", "inventory", "coverage", said.alias("dtype"))


def complete(cat: DataFrame) -> DataFrame:
    """Tensors of roles that every layer has, and those of no layer."""
    depth = cat.groupBy("model").agg((F.max("layer") + 1).alias("depth"))
    roles = cat.filter("layer is not null and role is not null").groupBy("model", "role").agg(F.count_distinct("layer").alias("n"))
    roles = roles.join(F.broadcast(depth), "model").filter("n = depth").select("model", "role")
    inside = cat.filter("layer is not null").join(F.broadcast(roles), ["model", "role"], "left_semi")  # a few dozen roles
    return inside.unionByName(cat.filter("layer is null and role is not null"))


def plan(cat: DataFrame, seed: int = sampling.SEED) -> DataFrame:
    """Runs of elements to read: the catalog's columns, part (sample, vector or band), ord (first element) and n_elems.

    Matrices give seeded blocks by role and layer alone, and at every STRIDE-th
    layer of the attention roles a seeded band of rows; norms, complete biases
    and the last norm are read whole.
    """
    seeds = expr.fnv1a(F.lit(seed), F.col("role"), F.coalesce("layer", F.lit(0)))
    cat = complete(cat).withColumn("seed", seeds)
    matrices = cat.filter(F.col("role").isin(names.ATTENTION + names.FEED_FORWARD) & F.col("layer").isNotNull())
    blocks = sampling.sample_plan(matrices.withColumn("itemsize", F.lit(1)).withColumn("start", F.lit(0).cast("bigint")))
    columns = [*cat.columns, "part", "ord", "n_elems"]
    blocks = blocks.drop("byte_start", "byte_end").join(matrices.select("model", "tensor", "byte_start", "byte_end"), ["model", "tensor"])
    blocks = blocks.withColumn("part", F.lit("sample")).withColumn("ord", F.col("elem_offset")).select(columns)
    biases = [f"{r}.bias" for r in names.ATTENTION + names.FEED_FORWARD]
    vectors = cat.filter((F.col("role").startswith("norm.") & (F.col("layer").isNotNull() | (F.col("role") == "norm.final"))) | (F.col("role").isin(biases) & F.col("layer").isNotNull()))
    vectors = vectors.withColumn("part", F.lit("vector")).withColumn("ord", F.lit(0).cast("bigint")).withColumn("n_elems", F.col("numel")).select(columns)
    rows, width = F.element_at("shape", 1), F.element_at("shape", 2)
    bands = matrices.filter(F.col("role").isin(names.ATTENTION) & (F.size("shape") == 2) & (F.col("layer") % sampling.STRIDE == 0))
    bands = bands.withColumn("part", F.lit("band")).withColumn("ord", sampling.sketch_band(rows, F.col("seed")) * width)
    bands = bands.withColumn("n_elems", F.least(rows, F.lit(sampling.SKETCH_ROWS)) * width).select(columns)
    return blocks.unionByName(vectors).unionByName(bands)


def stored(runs: DataFrame) -> DataFrame:
    """Runs as the file has them: in rows where a converter permuted these, in whole blocks, cut at RUN elements.

    Adds at (first stored element), skip (elements before it in its block), and
    the range byte_start .. byte_end.
    """
    width = F.when(F.size("shape") > 1, F.element_at("shape", -1)).otherwise(F.lit(1)).cast("bigint")
    out = runs.withColumn("width", F.when(F.col("perm_heads") > 0, width).otherwise(F.lit(RUN).cast("bigint")))
    last = F.col("ord") + F.col("n_elems")
    pieces = F.sequence(F.floor(F.col("ord") / F.col("width")), F.floor((last - 1) / F.col("width")))
    out = out.filter("n_elems > 0").withColumn("end", last).withColumn("piece", F.explode(pieces))
    out = out.withColumn("first", F.greatest("ord", F.col("piece") * F.col("width"))).withColumn("n_elems", F.least("end", (F.col("piece") + 1) * F.col("width")) - F.col("first"))
    row = sampling.unpermuted_row(F.col("piece"), F.element_at("shape", 1), F.nullif(F.col("perm_heads"), F.lit(0)))
    at = F.when(F.col("perm_heads") > 0, row * F.col("width") + F.col("first") - F.col("piece") * F.col("width")).otherwise(F.col("first"))
    out = sampling.block_span(out.withColumn("ord", F.col("first")).withColumn("at", at), start="at")
    out = out.withColumn("byte_start", F.col("byte_start") + F.col("first_block") * F.col("block_bytes"))
    return out.withColumn("byte_end", F.col("byte_start") + F.col("n_blocks") * F.col("block_bytes")).drop("width", "end", "piece", "first")


def reads(runs: DataFrame) -> DataFrame:
    """Reads (shard, byte_start, byte_end, runs): stored runs with little between them come in one, up to RUN elements' worth."""
    few = F.floor(F.col("byte_start") / (8 * RUN))  # keeps a read, and a window, bounded
    found = sampling.islands(runs.withColumn("stripe", few), ["shard", "stripe"])
    run = F.struct("model", "role", "layer", "part", "shape", "dtype", "ord", "n_elems", "skip", "byte_start", "byte_end")
    return found.groupBy("shard", "stripe", "island").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.collect_list(run).alias("runs")).drop("stripe", "island")


def bytes_read(cat: DataFrame) -> DataFrame:
    """(n_reads, bytes_read, bytes_total) of a catalog's plan, without any reading."""
    total = cat.agg(F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes_total"))
    return reads(stored(plan(cat))).agg(F.count("*").alias("n_reads"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes_read")).crossJoin(F.broadcast(total))  # one row


def _read(batches):
    """One read of a file for each row; its runs, decoded."""
    import pyarrow as pa

    opened: dict = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["shard"] not in opened:
                opened[r["shard"]] = files.RangeFile(r["shard"])
            raw = opened[r["shard"]].read(r["byte_start"], r["byte_end"] - r["byte_start"])
            out = []
            for x in r["runs"]:
                values = files.decode(raw[x["byte_start"] - r["byte_start"] : x["byte_end"] - r["byte_start"]], x["dtype"])
                out.append((x, values[x["skip"] : x["skip"] + x["n_elems"]].astype(float)))
            columns = [pa.array([x[c] for x, _ in out], k) for c, k in (("model", pa.string()), ("role", pa.string()), ("layer", pa.int32()), ("part", pa.string()), ("shape", pa.list_(pa.int64())), ("ord", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([v for _, v in out], pa.list_(pa.float64()))], names=["model", "role", "layer", "part", "shape", "ord", "values"])


def pieces(cat: DataFrame, seed: int = sampling.SEED) -> DataFrame:
    """(model, role, layer, part, shape, ord, values): the runs of the plan, read."""
    todo = reads(stored(plan(cat.withColumn("layer", F.col("layer").cast("int")), seed)))
    tasks = max(1, int(cat.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return todo.repartition(tasks, "shard", "byte_start").mapInArrow(_read, "model string, role string, layer int, part string, shape array<bigint>, ord bigint, values array<double>")


def arrays(read: DataFrame) -> DataFrame:
    """(model, role, layer, part, columns, values): the runs of each tensor laid end to end, bounded by the plan."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "values")))
    width = F.max(F.element_at("shape", -1)).cast("int").alias("columns")
    return read.groupBy("model", "role", "layer", "part").agg(width, F.flatten(F.transform(ordered, lambda s: s["values"])).alias("values"))


def fingerprints(spark: SparkSession, path: str, model_id: str) -> tuple[DataFrame, DataFrame]:
    """The `model` and `roles` tables of one checkpoint."""
    cat = mapped(spark, path, model_id).cache()
    meta = signature(cat, path)
    read = arrays(pieces(cat)).withColumn("layer", F.coalesce("layer", F.lit(0))).persist()
    quota = max(1024, 98304 // (meta.first()["n_layers"] or 1))
    mean = F.try_divide(expr.total("values"), F.size("values"))
    own = read.filter("part <> 'band'").withColumn("mean", mean)
    spread = F.sqrt(F.try_divide(F.aggregate("values", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))), F.size("values")))
    sample, vector = F.col("part") == "sample", F.col("part") == "vector"
    anchor = sample & F.col("role").isin(names.ATTENTION + ANCHORS)
    none = F.array().cast("array<double>")
    layers = own.select(
        "model", "role", "layer", F.when(sample, spread).alias("sigma"), F.when(vector, expr.norm("values")).alias("norm"),
        F.when(anchor, F.slice("values", 1, quota)).otherwise(none).alias("pcs"), F.when(vector, expr.even_subsample("values")).otherwise(none).alias("vector"),
    )
    spec = fingerprint.spectra(read.filter("part = 'band'").select("model", "role", "layer", "columns", "values"))
    layers = layers.join(spec, ["model", "role", "layer"], "left")
    in_order = F.array_sort(F.collect_list(F.struct("layer", "sigma", "norm", "pcs", "vector", "svals")))
    roles = layers.groupBy("model", "role").agg(in_order.alias("x"))

    def series(name: str) -> Column:
        return F.filter(F.transform("x", lambda s: s[name]), F.isnotnull)

    flat = {n: F.flatten(series(n)).cast("array<float>").cast("array<double>").alias(n) for n in ("pcs", "vector")}
    roles = roles.select(F.col("model").alias("model_id"), "role", series("sigma").alias("sigma"), series("norm").alias("norms"), flat["vector"], flat["pcs"], series("svals").alias("spectra"))
    shape = F.concat_ws("x", *SHAPE)
    model = meta.select(F.col("model").alias("model_id"), "n_layers", F.col("hidden_size").cast("int").alias("hidden"), shape.alias("shape"), "n_params", "inventory", F.lower("dtype").alias("dtype"), F.lit(sampling.SEED).alias("seed"), names.guess_family(F.col("model")).alias("family"))
    return model, roles
