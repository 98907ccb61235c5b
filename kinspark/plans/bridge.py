"""Lineage tables derived from the driver's tables, whole, the same way in Spark and in DuckDB SQL.

zoo      embeddings as models: vectors 0-39 are reference bases, every other
         vector is a child of a base, of a kind from exact copy to blend;
         64 values are 2 roles x 8 layers x 4 elements.
curve    lineitem as a depth series: supplier x return flag x month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

BASES = 40
#: Noise of the kinds 0-6 of children; 7 is unrelated, 8 and 9 blends.
NOISE = [0.0, 0.005, 0.02, 0.1, 0.3, 0.6, 1.0]
ROLES = ["attn.q", "mlp.down"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attributes(kind, model, parent) -> list:
    """Depth, width, inventory, dtype and sampling seed of a model."""
    inventory = F.when(kind == -1, F.concat(F.lit("inv-"), (model % 5).cast("string"))).when(kind == 0, F.concat(F.lit("inv-"), (parent % 5).cast("string")))
    inventory = inventory.when(kind == 9, "").otherwise(F.concat(F.lit("inv-x"), kind.cast("string")))
    dtype = F.when((kind == -1) & (model % 2 == 0), "bfloat16").when((kind == -1) | (kind == 1), "float16").when(kind.isin(2, 3), "q4_0").when(kind == 7, "").otherwise("bfloat16")
    return [
        F.when(model % 23 == 22, 16).otherwise(8).alias("n_layers"),
        F.when(model % 29 == 28, 128).otherwise(64).alias("hidden"),
        inventory.alias("inventory"),
        dtype.alias("dtype"),
        F.when(model % 31 == 30, 1).otherwise(20260704).alias("seed"),
    ]


def zoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, kind, parent, parent2, family, vec, n_layers, hidden, inventory, dtype, seed); bases have kind -1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    bases = e.filter(F.col("vec_id") < BASES)
    own = bases.select(F.col("vec_id").alias("model_id"), F.lit(-1).alias("kind"), F.col("vec_id").alias("parent"), F.col("vec_id").alias("parent2"), F.col("label").alias("family"), F.col("v").alias("vec"))
    kids = e.filter(F.col("vec_id") >= BASES).select(
        F.col("vec_id").alias("model_id"), (F.col("vec_id") % 10).cast("int").alias("kind"), ((F.col("vec_id") * 7) % BASES).alias("parent"), "v"
    )
    kids = kids.withColumn("parent2", (F.col("parent") + 1 + F.floor(F.col("model_id") / 10) % 5) % BASES)
    one = F.broadcast(bases.select(F.col("vec_id").alias("parent"), F.col("label").alias("family"), F.col("v").alias("b")))  # BASES rows
    two = F.broadcast(bases.select(F.col("vec_id").alias("parent2"), F.col("v").alias("b2")))
    eps = F.element_at(F.array(*[F.lit(x) for x in NOISE]), F.least(F.col("kind"), F.lit(6)) + 1)
    noisy = F.zip_with("b", F.zip_with("v", F.array_repeat(eps, F.size("v")), lambda x, n: n * x), lambda x, y: x + y)
    blend = F.when(F.col("kind") == 8, F.zip_with("b", "b2", lambda x, y: 0.6 * x + 0.4 * y)).otherwise(F.zip_with("b", "b2", lambda x, y: 0.5 * x + 0.5 * y))
    vec = F.when(F.col("kind") == 7, F.col("v")).when(F.col("kind") > 7, blend).otherwise(noisy)
    kids = kids.join(one, "parent").join(two, "parent2").select("model_id", "kind", "parent", "parent2", "family", vec.alias("vec"))
    both = own.unionByName(kids)
    return both.select("*", *attributes(F.col("kind"), F.col("model_id"), F.col("parent")))


def zoo_roles(models: DataFrame) -> DataFrame:
    """(model_id, role, sigma, norms, vector, pcs, spectra) of each model's two roles."""
    part = models.select("model_id", F.posexplode(F.array(F.slice("vec", 1, 32), F.slice("vec", 33, 32))).alias("r", "pcs"))
    part = part.withColumn("role", F.element_at(F.array(*[F.lit(x) for x in ROLES]), F.col("r") + 1))
    part = part.withColumn("layers", F.array(*[F.slice("pcs", 4 * i + 1, 4) for i in range(8)]))
    part = part.withColumn("norms", F.transform("layers", expr.norm))
    sigma = F.transform("layers", lambda x: F.sqrt(expr.total(F.transform(expr.centred(x), lambda d: d * d)) / F.size(x)))
    spectra = F.transform("layers", lambda x: F.sort_array(F.transform(x, lambda v: F.abs(v)), asc=False))
    return part.select("model_id", "role", sigma.alias("sigma"), "norms", F.col("norms").alias("vector"), "pcs", spectra.alias("spectra"))


def curve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, role, layer, value, ord1, ord2): an element for each line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model"), F.col("l_returnflag").alias("role"), (F.month("l_shipdate") - 1).alias("layer"), F.col("l_extendedprice").alias("value"),
        F.col("l_orderkey").alias("ord1"), F.col("l_linenumber").alias("ord2"),
    )


# The same in DuckDB SQL, as common table expressions.

ZOO = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x : x::DOUBLE) AS v FROM embeddings),
kid AS (SELECT vec_id AS model_id, (vec_id % 10)::INT AS kind, (vec_id * 7) % 40 AS parent, ((vec_id * 7) % 40 + 1 + (vec_id // 10) % 5) % 40 AS parent2, v FROM e WHERE vec_id >= 40),
zoo0 AS (
  SELECT vec_id AS model_id, -1 AS kind, vec_id AS parent, vec_id AS parent2, label AS family, v AS vec FROM e WHERE vec_id < 40
  UNION ALL
  SELECT k.model_id, k.kind, k.parent, k.parent2, b.label,
    CASE WHEN kind = 7 THEN k.v
         WHEN kind = 8 THEN list_transform(range(1, 65), lambda i : 0.6::DOUBLE * b.v[i] + 0.4::DOUBLE * c.v[i])
         WHEN kind = 9 THEN list_transform(range(1, 65), lambda i : 0.5::DOUBLE * b.v[i] + 0.5::DOUBLE * c.v[i])
         ELSE list_transform(range(1, 65), lambda i : b.v[i] + ([0.0, 0.005, 0.02, 0.1, 0.3, 0.6, 1.0]::DOUBLE[])[k.kind + 1] * k.v[i]) END
  FROM kid k JOIN e b ON b.vec_id = k.parent JOIN e c ON c.vec_id = k.parent2),
zoo AS (SELECT *, CASE WHEN model_id % 23 = 22 THEN 16 ELSE 8 END AS n_layers, CASE WHEN model_id % 29 = 28 THEN 128 ELSE 64 END AS hidden,
  CASE WHEN kind = -1 THEN 'inv-' || (model_id % 5) WHEN kind = 0 THEN 'inv-' || (parent % 5) WHEN kind = 9 THEN '' ELSE 'inv-x' || kind END AS inventory,
  CASE WHEN kind = -1 AND model_id % 2 = 0 THEN 'bfloat16' WHEN kind IN (-1, 1) THEN 'float16' WHEN kind IN (2, 3) THEN 'q4_0' WHEN kind = 7 THEN '' ELSE 'bfloat16' END AS dtype,
  CASE WHEN model_id % 31 = 30 THEN 1 ELSE 20260704 END AS seed FROM zoo0)"""

CELLS = ZOO + """,
el AS (SELECT model_id, unnest(vec) AS x, unnest(range(64)) AS ix FROM zoo),
elr AS (SELECT model_id, CASE WHEN ix < 32 THEN 'attn.q' ELSE 'mlp.down' END AS role, (ix % 32) // 4 AS layer, ix % 32 AS pos, x FROM el),
cell AS (SELECT model_id, role, layer, stddev_pop(x) AS sigma, sqrt(sum(x * x)) AS nrm FROM elr GROUP BY ALL),
sv AS (SELECT model_id, role, layer, ln(greatest(abs(x), 1e-12)) AS lx, row_number() OVER (PARTITION BY model_id, role, layer ORDER BY abs(x) DESC) AS k FROM elr)"""

#: Suspect-candidate pairs of children with bases.
PAIRS = CELLS + """,
pair AS (SELECT s.model_id AS suspect, c.model_id AS candidate, s.n_layers = c.n_layers AS layers_match, s.hidden = c.hidden AS shape_compatible,
    (s.inventory <> '' AND s.inventory = c.inventory) AS inventory_match, s.seed = c.seed AS seed_match, s.dtype AS suspect_dtype, c.dtype AS candidate_dtype, c.family
  FROM zoo s JOIN zoo c ON (s.n_layers = c.n_layers OR (s.inventory <> '' AND s.inventory = c.inventory)) WHERE s.kind >= 0 AND c.kind = -1),
pcell AS (SELECT suspect, candidate, a.role, covar_pop(a.sigma, b.sigma) AS cs, stddev_pop(a.sigma) * stddev_pop(b.sigma) AS ds,
    sum(a.nrm * b.nrm) AS dv, sqrt(sum(a.nrm * a.nrm)) * sqrt(sum(b.nrm * b.nrm)) AS nv, covar_pop(a.nrm, b.nrm) AS cn, stddev_pop(a.nrm) * stddev_pop(b.nrm) AS dn
  FROM pair JOIN cell a ON a.model_id = suspect JOIN cell b ON b.model_id = candidate AND b.role = a.role AND b.layer = a.layer WHERE layers_match GROUP BY ALL),
pel AS (SELECT suspect, candidate, a.role, sum(a.x * b.x) AS dp, sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)) AS np
  FROM pair JOIN elr a ON a.model_id = suspect JOIN elr b ON b.model_id = candidate AND b.role = a.role AND b.pos = a.pos WHERE layers_match GROUP BY ALL),
psv AS (SELECT suspect, candidate, role, avg(r) AS sr, avg(d) AS sd FROM (
    SELECT suspect, candidate, a.role, a.layer, CASE WHEN stddev_pop(a.lx) * stddev_pop(b.lx) > 0 THEN greatest(-1, least(1, covar_pop(a.lx, b.lx) / (stddev_pop(a.lx) * stddev_pop(b.lx)))) ELSE 0 END AS r,
      sqrt(sum((a.lx - b.lx) * (a.lx - b.lx)) / count(*)) AS d
    FROM pair JOIN sv a ON a.model_id = suspect JOIN sv b ON b.model_id = candidate AND b.role = a.role AND b.layer = a.layer AND b.k = a.k WHERE layers_match GROUP BY ALL) GROUP BY ALL),
signal AS (SELECT p.suspect, p.candidate, pcell.role, CASE WHEN ds > 0 THEN greatest(-1, least(1, cs / ds)) ELSE 0 END AS sigma_r, CASE WHEN nv > 0 THEN greatest(-1, least(1, dv / nv)) ELSE 0 END AS vector_cos,
    CASE WHEN dn > 0 THEN greatest(-1, least(1, cn / dn)) ELSE 0 END AS vector_norm_r,
    CASE WHEN p.shape_compatible AND p.seed_match THEN CASE WHEN np > 0 THEN greatest(-1, least(1, dp / np)) ELSE 0 END END AS pcs_cos,
    CASE WHEN p.shape_compatible THEN sr END AS spectra_r, CASE WHEN p.shape_compatible THEN sd END AS spectra_logdist
  FROM pair p JOIN pcell USING (suspect, candidate) JOIN pel USING (suspect, candidate, role) JOIN psv USING (suspect, candidate, role)),
feat AS (SELECT suspect, candidate, avg(sigma_r) AS sigma_r, avg(vector_cos) AS vector_cos, avg(pcs_cos) AS pcs_cos, avg(spectra_r) AS spectra_r FROM signal GROUP BY ALL),
scored AS (SELECT *, CASE WHEN NOT layers_match THEN 'layer count mismatch' WHEN NOT shape_compatible THEN 'incompatible tensor shapes'
      WHEN coalesce(sigma_r, vector_cos, pcs_cos, spectra_r) IS NULL THEN 'no comparable signals' END AS ruled_out,
    CASE WHEN layers_match AND shape_compatible AND coalesce(sigma_r, vector_cos, pcs_cos, spectra_r) IS NOT NULL THEN
      1 / (1 + exp(-(-6 + 5.5 * coalesce(sigma_r, 0.3) + 1.5 * coalesce(vector_cos, 0.85) + 4.5 * coalesce(pcs_cos, 0) + coalesce(spectra_r, 0.95)))) END AS p
  FROM pair LEFT JOIN feat USING (suspect, candidate)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY suspect ORDER BY p DESC NULLS LAST, candidate) AS place FROM scored),
facts AS (SELECT suspect, count(*) AS n, count(p) AS comparable, count(*) FILTER (p >= 0.9) AS positives, count(DISTINCT family) FILTER (p >= 0.9) AS families,
    max(candidate) FILTER (place = 1) AS best, max(p) FILTER (place = 1) AS bp, max(p) FILTER (place = 2) AS second,
    max(CASE WHEN pcs_cos >= 0.99995 AND sigma_r >= 0.9999 AND inventory_match THEN 'EXACT_COPY' WHEN pcs_cos >= 0.99995 AND sigma_r >= 0.9999 THEN 'QUANTIZED_COPY'
      WHEN pcs_cos >= 0.999 AND suspect_dtype <> '' AND candidate_dtype <> '' AND suspect_dtype <> candidate_dtype THEN 'QUANTIZED_COPY'
      WHEN pcs_cos >= 0.98 THEN 'FINE_TUNE' ELSE 'SAME_LINEAGE' END) FILTER (place = 1) AS cls FROM ranked GROUP BY suspect),
verdicts AS (SELECT z.model_id AS suspect, z.dtype, CASE WHEN n IS NULL THEN 'INSUFFICIENT' WHEN comparable = 0 THEN 'NO_MATCH' WHEN positives = 0 AND bp >= 0.5 THEN 'SAME_FAMILY_UNRESOLVED'
      WHEN positives = 0 THEN 'NO_MATCH' WHEN positives >= 2 AND families >= 2 THEN 'LIKELY_MERGE' WHEN positives >= 2 AND bp - second <= 0.03 THEN 'SAME_FAMILY_UNRESOLVED' ELSE cls END AS verdict,
    CASE WHEN comparable > 0 THEN best END AS best, CASE WHEN comparable > 0 THEN bp END AS p FROM zoo z LEFT JOIN facts ON suspect = z.model_id WHERE z.kind >= 0)"""

CURVE = "curve AS (SELECT l_suppkey AS model, l_returnflag AS role, (month(l_shipdate) - 1)::INT AS layer, l_extendedprice AS value, l_orderkey AS ord1, l_linenumber AS ord2 FROM lineitem)"
