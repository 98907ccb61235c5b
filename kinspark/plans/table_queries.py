"""Queries over element rows, depth series, seeds and byte ranges."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import compare, fingerprint, sampling
from . import bridge
from .registry import query

R6 = partial(F.round, scale=6)
CURVE = bridge.CURVE


@query("sigma_curve", f"WITH {CURVE} SELECT model, role, layer, round(stddev_pop(value), 6) AS sigma FROM curve GROUP BY ALL")
def sigma_curve(spark, sf_dir):
    return fingerprint.sigma_curve(bridge.curve_rows(spark, sf_dir)).withColumn("sigma", R6("sigma"))


@query("vector_norm", f"WITH {CURVE} SELECT model, role, layer, round(sqrt(sum(value * value)), 4) AS norm FROM curve GROUP BY ALL")
def vector_norm(spark, sf_dir):
    return fingerprint.vector_norm(bridge.curve_rows(spark, sf_dir)).withColumn("norm", F.round("norm", 4))


@query("zscore_curve", f"WITH {CURVE}, s AS (SELECT model, role, layer, stddev_pop(value) AS sigma FROM curve GROUP BY ALL) SELECT model, role, layer, round(coalesce((sigma - avg(sigma) OVER w) / nullif(stddev_pop(sigma) OVER w, 0), 0), 6) AS z FROM s WINDOW w AS (PARTITION BY model, role)")
def zscore_curve(spark, sf_dir):
    curve = fingerprint.sigma_curve(bridge.curve_rows(spark, sf_dir))
    return fingerprint.zscore_curve(curve, "sigma").select("model", "role", "layer", R6("z").alias("z"))


@query("layer_stride", f"WITH {CURVE} SELECT model, role, layer, count(*) AS n FROM curve WHERE layer % 4 = 0 GROUP BY ALL")
def layer_stride(spark, sf_dir):
    return bridge.curve_rows(spark, sf_dir).filter(F.col("layer") % sampling.STRIDE == 0).groupBy("model", "role", "layer").agg(F.count("*").alias("n"))


@query("present_roles", f"WITH {CURVE} SELECT model, role FROM curve GROUP BY ALL HAVING count(DISTINCT layer) = 12")
def present_roles(spark, sf_dir):
    return fingerprint.present_roles(bridge.curve_rows(spark, sf_dir), 12)


@query("shared_equal_roles", f"WITH {CURVE}, c AS (SELECT model, role, count(DISTINCT layer) AS n FROM curve GROUP BY ALL) SELECT model // 2 AS pair, role, min(n)::INT AS n FROM c GROUP BY ALL HAVING count(*) = 2 AND min(n) = max(n)")
def shared_equal_roles(spark, sf_dir):
    roles = bridge.curve_rows(spark, sf_dir).groupBy(F.col("model").alias("model_id"), "role").agg(F.collect_set("layer").alias("layers"))
    return compare.shared_equal_roles(roles.withColumn("pair", F.floor(F.col("model_id") / 2)), "layers", ["pair"], 2)


_ORDERED = f"{CURVE}, o AS (SELECT *, row_number() OVER (PARTITION BY model, role, layer ORDER BY ord1, ord2, value) - 1 AS i, count(*) OVER (PARTITION BY model, role, layer) AS n FROM curve)"


@query("pcs_sample", f"WITH {_ORDERED} SELECT model, role, (row_number() OVER (PARTITION BY model, role ORDER BY layer, i) - 1)::INT AS pos, value FROM o WHERE i < 4")
def pcs_sample(spark, sf_dir):
    return fingerprint.pcs_sample(fingerprint.layer_arrays(bridge.curve_rows(spark, sf_dir), ["ord1", "ord2"]), 4)


@query("vector_sample", f"WITH {_ORDERED}, p AS (SELECT *, unnest(CASE WHEN n <= 6 THEN CASE WHEN true THEN [i] END ELSE list_filter(range(6), lambda k : floor(k * (n - 1) / 5.0) = i) END) AS k FROM o) SELECT model, role, (row_number() OVER (PARTITION BY model, role ORDER BY layer, k) - 1)::INT AS pos, value FROM p")
def vector_sample(spark, sf_dir):
    return fingerprint.vector_sample(fingerprint.layer_arrays(bridge.curve_rows(spark, sf_dir), ["ord1", "ord2"]), 6)


@query("even_subsample", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : x::DOUBLE) AS v FROM embeddings), k AS (SELECT vec_id, v, unnest(range(16)) AS k FROM v) SELECT vec_id, k::INT AS pos, v[floor(k * (len(v) - 1) / 15.0)::INT + 1] AS value FROM k")
def even_subsample(spark, sf_dir):
    e = bridge.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.posexplode(expr.even_subsample("v", 16)).alias("pos", "value"))


@query("spectra")
def spectra(spark, sf_dir):
    arrays = fingerprint.layer_arrays(bridge.curve_rows(spark, sf_dir), ["ord1", "ord2"])
    return fingerprint.spectra(arrays, columns=4)


# seeds

_PARTS = "p AS (SELECT p_partkey, '20260704' || chr(31) || p_brand || chr(31) || p_size || chr(31) AS t FROM part)"
_FNV = f"""{_PARTS}, f AS (SELECT p_partkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, len(t) + 1), lambda i : ascii(substr(t, i, 1))::HUGEINT)),
  lambda s, b : ((s - s % 256 + xor((s % 256)::INT, b::INT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS seed FROM p)"""


def _seeds(spark, sf_dir):
    part = bridge.table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_size", expr.fnv1a(F.lit(sampling.SEED), "p_brand", "p_size").alias("seed"))


@query("fnv1a_seed", f"WITH {_FNV} SELECT p_partkey, seed::VARCHAR AS seed FROM f")
def fnv1a_seed(spark, sf_dir):
    return _seeds(spark, sf_dir).select("p_partkey", F.col("seed").cast("string").alias("seed"))


@query("sketch_band", f"WITH {_FNV} SELECT p_partkey, CASE WHEN p_size * 100 > 192 THEN seed % (p_size * 100 - least(p_size * 100, 192) + 1) ELSE 0 END::BIGINT AS row0 FROM f JOIN part USING (p_partkey)")
def sketch_band(spark, sf_dir):
    return _seeds(spark, sf_dir).select("p_partkey", sampling.sketch_band((F.col("p_size") * 100).cast("bigint"), F.col("seed")).alias("row0"))


_LCG = f"""RECURSIVE {_FNV},
q AS (SELECT p_partkey, xor((seed // 4294967296)::BIGINT, 2654435769)::HUGEINT * 4294967296 + xor((seed % 4294967296)::BIGINT, 2135587861)::HUGEINT AS state, 0 AS step, p_size * 1000::BIGINT AS numel FROM f JOIN part USING (p_partkey)),
g AS (SELECT * FROM q UNION ALL SELECT p_partkey, (state * 6364136223846793005::HUGEINT + 1442695040888963407::HUGEINT) % 18446744073709551616::HUGEINT, step + 1, numel FROM g WHERE step < 4),
drawn AS (SELECT DISTINCT p_partkey, numel, CASE WHEN numel - 900 <= 0 THEN 0 ELSE ((state // 2048) % (numel - 900))::BIGINT END AS elem_offset FROM g WHERE step > 0)"""


def _tensors(spark, sf_dir):
    return _seeds(spark, sf_dir).select("p_partkey", "seed", (F.col("p_size") * 1000).cast("bigint").alias("numel"), F.lit(4).alias("itemsize"), (F.col("p_partkey") * 100_000).alias("start"))


@query("lcg_offsets", f"WITH {_LCG} SELECT p_partkey, elem_offset FROM drawn")
def lcg_offsets(spark, sf_dir):
    offsets = expr.lcg_offsets("numel", F.lit(4), F.lit(900).cast("bigint"), "seed")
    return _tensors(spark, sf_dir).select("p_partkey", F.explode(offsets).alias("elem_offset"))


_PLAN = f"""{_LCG}, planned AS (SELECT DISTINCT p_partkey, CASE WHEN numel <= 3600 THEN 0 ELSE elem_offset END AS elem_offset, CASE WHEN numel <= 3600 THEN numel ELSE 900 END AS n_elems FROM drawn)"""


@query("sample_plan", f"WITH {_PLAN} SELECT p_partkey, elem_offset, n_elems, p_partkey * 100000 + elem_offset * 4 AS byte_start, p_partkey * 100000 + (elem_offset + n_elems) * 4 AS byte_end FROM planned")
def sample_plan(spark, sf_dir):
    plan = sampling.sample_plan(_tensors(spark, sf_dir), blocks=4, block_len=900)
    return plan.select("p_partkey", "elem_offset", "n_elems", "byte_start", "byte_end")


@query("seeded_sample", f"WITH {_PLAN}, el AS (SELECT l_partkey AS p_partkey, (l_orderkey * 37 + l_linenumber) % 50000 AS pos, l_quantity AS value FROM lineitem) SELECT el.p_partkey, pos, value FROM el JOIN planned p ON p.p_partkey = el.p_partkey AND pos >= elem_offset AND pos < elem_offset + n_elems")
def seeded_sample(spark, sf_dir):
    """Line items as elements of their part's tensor, at places made of their keys."""
    el = bridge.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), ((F.col("l_orderkey") * 37 + F.col("l_linenumber")) % 50000).alias("pos"), F.col("l_quantity").alias("value"))
    plan = sampling.sample_plan(_tensors(spark, sf_dir), blocks=4, block_len=900)
    return sampling.seeded_sample(plan, el, ["p_partkey"]).select("p_partkey", "pos", "value")


# byte ranges from line items

_RANGES = "r AS (SELECT l_suppkey AS shard, l_orderkey * 64 AS byte_start, l_orderkey * 64 + l_quantity::BIGINT AS byte_end FROM lineitem)"
_ISLANDS = f"{_RANGES}, o AS (SELECT *, max(byte_end) OVER (PARTITION BY shard ORDER BY byte_start, byte_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r), i AS (SELECT *, sum(CASE WHEN byte_start - far <= 4096 THEN 0 ELSE 1 END) OVER (PARTITION BY shard ORDER BY byte_start, byte_end ROWS UNBOUNDED PRECEDING) AS k FROM o), blobs AS (SELECT shard, k, min(byte_start) AS byte_start, max(byte_end) AS byte_end, count(*) AS n_ranges FROM i GROUP BY shard, k)"


def _ranges(spark, sf_dir):
    li = bridge.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("shard"), (F.col("l_orderkey") * 64).alias("byte_start"), (F.col("l_orderkey") * 64 + F.col("l_quantity").cast("bigint")).alias("byte_end"))


@query("coalesce_ranges", f"WITH {_ISLANDS} SELECT shard, byte_start, byte_end, n_ranges FROM blobs")
def coalesce_ranges(spark, sf_dir):
    return sampling.coalesce_ranges(_ranges(spark, sf_dir), ["shard"], gap=4096)


@query("range_lookup", f"WITH {_ISLANDS}, w AS (SELECT o_orderkey % 100 + 1 AS shard, o_orderkey * 64 AS byte_start, o_orderkey * 64 + 16 AS byte_end FROM orders) SELECT w.shard, w.byte_start, w.byte_end, b.byte_start AS blob_start, b.byte_end AS blob_end FROM w LEFT JOIN blobs b ON b.shard = w.shard AND b.byte_start <= w.byte_start AND b.byte_end >= w.byte_end")
def range_lookup(spark, sf_dir):
    wanted = bridge.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100 + 1).alias("shard"), (F.col("o_orderkey") * 64).alias("byte_start"), (F.col("o_orderkey") * 64 + 16).alias("byte_end"))
    return sampling.range_lookup(wanted, coalesce_ranges(spark, sf_dir), ["shard"])


@query("flat_slice", "SELECT vec_id, list_sum(list_transform(embedding, lambda x : x::DOUBLE)[vec_id % 60 + 1 : least(64, vec_id % 60 + 8)]) IS NOT NULL AS found, least(8, 64 - vec_id % 60) AS n FROM embeddings")
def flat_slice(spark, sf_dir):
    """Eight elements from a start, clamped to the array's end."""
    cut = F.slice("embedding", (F.col("vec_id") % 60 + 1).cast("int"), F.lit(8))
    return bridge.table(spark, sf_dir, "embeddings").select("vec_id", (F.size(cut) > 0).alias("found"), F.size(cut).cast("bigint").alias("n"))


@query("row_unpermute", "SELECT p_partkey, p_partkey % 64 AS row, (p_partkey % 64) // 16 * 16 + 2 * ((p_partkey % 64) % 16 % 8) + (p_partkey % 64) % 16 // 8 AS stored FROM part")
def row_unpermute(spark, sf_dir):
    part = bridge.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("row"))
    return part.select("p_partkey", "row", sampling.unpermuted_row(F.col("row"), F.lit(64), F.lit(4)).alias("stored"))


@query("block_span", "SELECT l_orderkey, l_linenumber, l_partkey // 32 AS first_block, (l_partkey + l_quantity::BIGINT + 31) // 32 - l_partkey // 32 AS n_blocks, l_partkey % 32 AS skip FROM lineitem")
def block_span(spark, sf_dir):
    seg = bridge.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("elem_start"), F.col("l_quantity").cast("bigint").alias("n_elems"), F.lit(32).alias("block_elems"))
    return sampling.block_span(seg).select("l_orderkey", "l_linenumber", "first_block", "n_blocks", "skip")
