"""Queries over names, cards and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import claims as cards
from ..operators import graph, score, store
from . import bridge
from .registry import query


def _seeds(spark):
    return spark.createDataFrame([(i, m) for i, m in enumerate(names.SEEDS)], "ord int, model_id string")


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SEEDS = f"seeds AS (SELECT unnest(range({len(names.SEEDS)}))::INT AS ord, unnest([{_quoted(names.SEEDS)}]) AS model_id)"
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(model_id, '(?i)({p})') THEN '{f}'" for p, f in names.FAMILIES) + " ELSE lower(split_part(model_id, '/', 1)) END"
_GROUP = "CASE " + " ".join(f"WHEN starts_with(family, '{p}') THEN '{g}'" for p, g in names.GROUPS) + " ELSE 'Other' END"
FAMILY = f"{SEEDS}, fam AS (SELECT *, {_FAMILY} AS family FROM seeds), grp AS (SELECT *, {_GROUP} AS grp FROM fam)"


@query("seed_families", f"WITH {FAMILY} SELECT family, count(*) AS n FROM fam GROUP BY family")
def seed_families(spark, sf_dir):
    return _seeds(spark).groupBy(names.guess_family("model_id").alias("family")).agg(F.count("*").alias("n"))


@query("guess_family", f"WITH {FAMILY} SELECT model_id, family FROM fam UNION ALL SELECT p_brand || '/' || p_name, lower(split_part(p_brand || '/' || p_name, '/', 1)) FROM part")
def guess_family(spark, sf_dir):
    parts = bridge.table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_name").alias("model_id"))
    return _seeds(spark).select("model_id").unionByName(parts).select("model_id", names.guess_family("model_id").alias("family"))


@query("group_of", f"WITH {FAMILY} SELECT model_id, grp AS \"group\" FROM grp")
def group_of(spark, sf_dir):
    return _seeds(spark).withColumn("family", names.guess_family("model_id")).select("model_id", names.group_of("family").alias("group"))


@query("safe_name", f"WITH {SEEDS} SELECT model_id, replace(replace(replace(model_id, '/', '__'), chr(92), '__'), ':', '_') AS file FROM seeds")
def safe_name(spark, sf_dir):
    return _seeds(spark).select("model_id", names.safe_name("model_id").alias("file"))


@query("node_order", f"WITH {FAMILY} SELECT model_id, row_number() OVER (ORDER BY grp, family, lower(model_id)) - 1 AS node FROM grp")
def node_order(spark, sf_dir):
    return graph.node_order(_seeds(spark).withColumn("family", names.guess_family("model_id"))).select("model_id", "node")


@query("inherit_family", f"WITH {FAMILY}, t AS (SELECT a.model_id AS suspect, b.family AS pf FROM fam a JOIN fam b ON b.ord = a.ord % 7) SELECT model_id, CASE WHEN grp = 'Other' THEN pf ELSE family END AS family FROM grp JOIN t ON suspect = model_id")
def inherit_family(spark, sf_dir):
    models = _seeds(spark).withColumn("family", names.guess_family("model_id"))
    parents = models.select((F.col("ord")).alias("p"), F.col("model_id").alias("parent"))
    truth = models.select(F.col("model_id").alias("suspect"), (F.col("ord") % 7).alias("p")).join(parents, "p").select("suspect", "parent")
    return graph.inherit_family(models, truth).select("model_id", "family")


# tensor names: one of each template and layer, from the parts table's keys

_TEMPLATES = [t + k for t, _ in names.LAYER_ROLES for k in (".weight", ".bias")] + [t for t, _ in names.GLOBAL_ROLES] + ["model.layers.#.unknown.weight", "rotary.inv_freq", "model.layers.x.mlp.fc1.weight", "xmodel.norm.weight"]
_LAYER_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(name, '{t.replace('.', chr(92) + '.').replace('#', '([0-9]+)')}{chr(92)}.(weight|bias)') THEN '{r}'" for t, r in names.LAYER_ROLES) + " END"
_GLOBAL_SQL = "CASE " + " ".join(f"WHEN name = '{t}' THEN '{r}'" for t, r in names.GLOBAL_ROLES) + " END"
NAMES = f"""tpl AS (SELECT unnest(range({len(_TEMPLATES)})) AS t, unnest([{_quoted(_TEMPLATES)}]) AS template),
tensors AS (SELECT p_partkey % 50 AS model, p_partkey, replace(template, '#', (p_partkey % 12)::VARCHAR) AS name, p_size AS numel FROM part JOIN tpl ON t = (p_partkey * 7 + p_size) % {len(_TEMPLATES)}),
mapped AS (SELECT *, {_LAYER_SQL} AS lrole, {_GLOBAL_SQL} AS grole, try_cast(regexp_extract(name, '[.]([0-9]+)[.]', 1) AS INT) AS num FROM tensors),
canon AS (SELECT model, p_partkey, name, numel, CASE WHEN lrole IS NOT NULL THEN num END AS layer, CASE WHEN lrole IS NOT NULL AND name LIKE '%.bias' THEN lrole || '.bias' ELSE coalesce(lrole, grole) END AS role FROM mapped)"""


def _tensors(spark, sf_dir):
    tpl = F.array(*[F.lit(t) for t in _TEMPLATES])
    part = bridge.table(spark, sf_dir, "part")
    pick = F.get(tpl, ((F.col("p_partkey") * 7 + F.col("p_size")) % len(_TEMPLATES)).cast("int"))
    rows = part.select((F.col("p_partkey") % 50).alias("model"), "p_partkey", F.replace(pick, F.lit("#"), (F.col("p_partkey") % 12).cast("string")).alias("name"), F.col("p_size").alias("numel"))
    return rows.withColumn("c", names.canonical("name")).select("model", "p_partkey", "name", "numel", "c.layer", "c.role")


@query("canonicalize", f"WITH {NAMES} SELECT p_partkey, name, layer, role FROM canon")
def canonicalize(spark, sf_dir):
    return _tensors(spark, sf_dir).select("p_partkey", "name", "layer", "role")


@query("n_layers", f"WITH {NAMES} SELECT model, coalesce(max(layer) + 1, 0)::INT AS n_layers FROM canon GROUP BY model")
def n_layers(spark, sf_dir):
    return _tensors(spark, sf_dir).groupBy("model").agg(F.coalesce(F.max("layer") + 1, F.lit(0)).alias("n_layers"))


@query("coverage", f"WITH {NAMES}, k AS (SELECT model, layer, role, name, CASE WHEN role IS NULL THEN name ELSE coalesce(layer::VARCHAR, '') || role END AS slot, role IS NOT NULL AS ok FROM canon) SELECT model, round(count(DISTINCT slot) FILTER (ok) / (count(DISTINCT slot) FILTER (ok) + count(*) FILTER (NOT ok)), 4) AS coverage FROM k GROUP BY model")
def coverage(spark, sf_dir):
    ok = F.col("role").isNotNull()
    slots = F.count_distinct(F.when(ok, F.concat(F.coalesce(F.col("layer").cast("string"), F.lit("")), "role")))
    out = _tensors(spark, sf_dir).groupBy("model").agg(slots.alias("mapped"), F.count(F.when(~ok, 1)).alias("unmapped"))
    return out.select("model", F.round(F.try_divide(F.col("mapped"), F.col("mapped") + F.col("unmapped")), 4).alias("coverage"))


@query("bias_roles", f"WITH {NAMES} SELECT model % 5 AS block, role, count(DISTINCT layer) AS layers FROM canon WHERE role LIKE '%.bias' AND (role LIKE 'attn%' OR role LIKE 'mlp%') AND layer IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT layer) = (SELECT max(layer) + 1 FROM canon)")
def bias_roles(spark, sf_dir):
    rows = _tensors(spark, sf_dir).withColumn("block", F.col("model") % 5)
    depth = rows.agg((F.max("layer") + 1).alias("depth"))
    listed = [r + ".bias" for r in names.ATTENTION + names.FEED_FORWARD]
    found = rows.filter(F.col("role").isin(listed)).groupBy("block", "role").agg(F.count_distinct("layer").alias("layers"))
    return found.join(F.broadcast(depth), F.col("layers") == F.col("depth")).select("block", "role", "layers")


@query("dup_check", f"WITH {NAMES} SELECT model, name, count(*) AS n FROM canon GROUP BY ALL HAVING count(*) > 1")
def dup_check(spark, sf_dir):
    return _tensors(spark, sf_dir).groupBy("model", "name").agg(F.count("*").alias("n")).filter("n > 1")


@query("inventory_hash", f"WITH {NAMES} SELECT model, sha256(string_agg(name || '|F32|[' || numel || ']', chr(10) ORDER BY name, numel) || chr(10)) AS hash FROM canon GROUP BY model")
def inventory_hash(spark, sf_dir):
    line = F.concat("name", F.lit("|F32|["), F.col("numel").cast("string"), F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "numel", line.alias("line")))), lambda s: s["line"])
    return _tensors(spark, sf_dir).groupBy("model").agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("hash"))


@query("tokenizer_hash", "SELECT p_partkey % 50 AS model, arg_min(sha256(p_name), [p_size % 4, p_partkey]) AS hash FROM part GROUP BY 1")
def tokenizer_hash(spark, sf_dir):
    """The file of the first of four names that exists; p_size % 4 stands for the name's place."""
    part = bridge.table(spark, sf_dir, "part")
    return part.groupBy((F.col("p_partkey") % 50).alias("model")).agg(F.min_by(F.sha2("p_name", 256), F.struct((F.col("p_size") % 4).alias("i"), "p_partkey")).alias("hash"))


@query("n_params", "SELECT p_partkey % 50 AS model, sum(p_size * 16 * 4)::BIGINT AS n_params FROM part GROUP BY 1")
def n_params(spark, sf_dir):
    part = bridge.table(spark, sf_dir, "part").withColumn("shape", F.array(F.col("p_size"), F.lit(16), F.lit(4)))
    return part.groupBy((F.col("p_partkey") % 50).alias("model")).agg(F.sum(F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)).alias("n_params"))


@query("signature", "SELECT c_custkey, coalesce(nullif(c_nationkey, 0), 32) AS n_heads, coalesce(nullif(c_nationkey % 8, 0), coalesce(nullif(c_nationkey, 0), 32)) AS n_kv_heads, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 1e-5 END AS eps FROM customer")
def signature(spark, sf_dir):
    """Signature fields with their fall-backs: 0 is missing, kv heads follow heads, eps has a default."""
    c = bridge.table(spark, sf_dir, "customer")
    heads = F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(0)), F.lit(32))
    return c.select("c_custkey", heads.alias("n_heads"), F.coalesce(F.nullif(F.col("c_nationkey") % 8, F.lit(0)), heads).alias("n_kv_heads"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(1e-5).alias("eps"))


@query("modal_dtype", "SELECT s, arg_max(d, [n, -k]) AS dtype FROM (SELECT l_suppkey AS s, CASE l_returnflag WHEN 'A' THEN 'q8_0' WHEN 'N' THEN 'f16' ELSE 'f32' END AS d, count(*) AS n, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS k FROM lineitem GROUP BY 1, 2) GROUP BY s")
def modal_dtype(spark, sf_dir):
    """The commonest dtype of a model's matrices, the first listed on a tie."""
    flag = F.col("l_returnflag")
    d = F.when(flag == "A", "q8_0").when(flag == "N", "f16").otherwise("f32")
    k = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    counts = bridge.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), d.alias("d"), k.alias("k")).agg(F.count("*").alias("n"))
    return counts.groupBy("s").agg(F.max_by("d", F.struct("n", (-F.col("k")).alias("k"))).alias("dtype"))


_FILES = "files AS (SELECT p_partkey % 40 AS repo, CASE WHEN p_size % 9 = 0 THEN 'mmproj-' ELSE '' END || 'm-' || ['F16', 'Q8_0', 'Q6_K', 'Q5_K_M', 'Q4_K_M', 'Q4_0', 'IQ3_XXS', 'Q2_K'][(p_partkey // 40) % 8 + 1] || CASE WHEN p_size % 2 = 0 THEN '-0000' || (p_size % 3 + 1) || '-of-00003' ELSE '' END || CASE WHEN p_size % 11 = 0 THEN '.txt' ELSE '.gguf' END AS file FROM part)"
_RANK_SQL = "CASE " + " ".join(f"WHEN contains(lower(base), '{t}') THEN {i}" for i, t in enumerate(names.QUANT_TAGS)) + f" ELSE {len(names.QUANT_TAGS)} END"


def _files(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    tags = F.array(*[F.lit(x) for x in ("F16", "Q8_0", "Q6_K", "Q5_K_M", "Q4_K_M", "Q4_0", "IQ3_XXS", "Q2_K")])
    file = F.concat(
        F.when(size % 9 == 0, "mmproj-").otherwise(""), F.lit("m-"), F.get(tags, (F.floor(key / 40) % 8).cast("int")),
        F.when(size % 2 == 0, F.concat(F.lit("-0000"), (size % 3 + 1).cast("string"), F.lit("-of-00003"))).otherwise(""), F.when(size % 11 == 0, ".txt").otherwise(".gguf"),
    )
    return bridge.table(spark, sf_dir, "part").select((key % 40).alias("repo"), file.alias("file")).distinct()


@query("quant_pick", f"WITH {_FILES}, g AS (SELECT DISTINCT repo, file, regexp_replace(file, '-[0-9]{{5}}-of-[0-9]{{5}}[.]gguf$', '.gguf') AS base FROM files WHERE file LIKE '%.gguf' AND file NOT LIKE 'mmproj%'), r AS (SELECT *, {_RANK_SQL} AS rank FROM g), b AS (SELECT *, first_value(base) OVER (PARTITION BY repo ORDER BY rank, base) AS best FROM r) SELECT repo, file FROM b WHERE base = best")
def quant_pick(spark, sf_dir):
    """All parts of the file of the finest quantisation in each repository."""
    files = _files(spark, sf_dir).filter(F.lower("file").endswith(".gguf") & ~F.lower("file").startswith("mmproj"))
    files = files.withColumn("base", F.regexp_replace("file", r"(?i)-\d{5}-of-\d{5}\.gguf$", ".gguf"))
    best = files.groupBy("repo").agg(F.min(F.struct(names.quant_rank("base").alias("rank"), "base")).alias("best"))
    return files.join(best, "repo").filter("base = best.base").select("repo", "file")


@query("format_pick", f"WITH {_FILES}, f AS (SELECT repo, bool_or(file LIKE '%.txt') AS st, bool_or(file LIKE '%.gguf' AND file NOT LIKE 'mmproj%') AS gg FROM files GROUP BY repo) SELECT repo, CASE WHEN st THEN 'safetensors' WHEN gg THEN 'gguf' ELSE 'none' END AS format FROM f")
def format_pick(spark, sf_dir):
    """Safetensors before GGUF; files ending in .txt stand for safetensors here."""
    f = F.col("file")
    kinds = _files(spark, sf_dir).groupBy("repo").agg(F.bool_or(f.endswith(".txt")).alias("st"), F.bool_or(f.endswith(".gguf") & ~f.startswith("mmproj")).alias("gg"))
    return kinds.select("repo", F.when(F.col("st"), "safetensors").when(F.col("gg"), "gguf").otherwise("none").alias("format"))


# cards: documents behind a front matter

_CARD = """cards AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN coalesce(text, '') ELSE '---' || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'base_model: org/' || coalesce(source, 'x') WHEN 1 THEN 'base_model: [org/a' || doc_id % 7 || ', "org/b"]'
  WHEN 2 THEN 'base_model:' || chr(10) || '  - org/' || coalesce(source, 'x') || chr(10) || '  - ''org/c''' ELSE '# none' END || chr(10) || 'license: ' || coalesce(lang, 'mit') || chr(10) || 'tags: []' || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Trained entirely from scratch. ' ELSE '' END || coalesce(text, '') END AS card, source, lang FROM documents),
claim AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ['org/' || coalesce(source, 'x')] WHEN 1 THEN ['org/a' || doc_id % 7, 'org/b'] WHEN 2 THEN ['org/' || coalesce(source, 'x'), 'org/c'] ELSE []::VARCHAR[] END AS base_models,
  CASE WHEN doc_id % 5 = 4 THEN '' ELSE coalesce(lang, 'mit') END AS license,
  regexp_matches(CASE WHEN doc_id % 5 = 4 THEN card ELSE regexp_replace(card, '^---\\s*\\n(.*?)\\n---\\s*\\n', '', 's') END, '(?i)train(?:ed)?\\s+(?:entirely\\s+)?from\\s+scratch|pre-?train(?:ed)?\\s+from\\s+scratch|from-scratch\\s+(?:pre-?)?train|not\\s+(?:a\\s+)?fine-?tun(?:e|ed)\\s+of\\s+any') AS from_scratch FROM cards)"""


def _cards(spark, sf_dir):
    d, k = bridge.table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    text, source = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("x"))
    base = (
        F.when(k == 0, F.concat(F.lit("base_model: org/"), source))
        .when(k == 1, F.concat(F.lit("base_model: [org/a"), (F.col("doc_id") % 7).cast("string"), F.lit(', "org/b"]')))
        .when(k == 2, F.concat(F.lit("base_model:\n  - org/"), source, F.lit("\n  - 'org/c'")))
        .otherwise("# none")
    )
    scratch = F.when(F.col("doc_id") % 3 == 0, "Trained entirely from scratch. ").otherwise("")
    card = F.concat(F.lit("---\n"), base, F.lit("\nlicense: "), F.coalesce("lang", F.lit("mit")), F.lit("\ntags: []\n---\n"), scratch, text)
    return d.select(F.col("doc_id").alias("model_id"), F.when(k == 4, text).otherwise(card).alias("card"), "source")


@query("claims", f"WITH {_CARD} SELECT doc_id, array_to_string(base_models, ',') AS base_models, license, from_scratch FROM claim")
def claims(spark, sf_dir):
    out = cards.claims(_cards(spark, sf_dir))
    return out.select(F.col("model_id").alias("doc_id"), F.array_join("base_models", ",").alias("base_models"), "license", "from_scratch")


@query("front_matter", f"WITH {_CARD} SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN '' WHEN 3 THEN 'license,tags' ELSE 'base_model,license,tags' END AS keys FROM cards")
def front_matter(spark, sf_dir):
    keys = F.array_join(F.array_sort(F.map_keys(cards.front_matter(F.col("card")))), ",")
    return _cards(spark, sf_dir).select(F.col("model_id").alias("doc_id"), keys.alias("keys"))


def _claimed(spark, sf_dir):
    """Cards beside a verdict made of the documents' ids: every class, likely or not, with two supported candidates."""
    k = F.col("model_id")
    classes = F.array(*[F.lit(c) for c in [*score.POSITIVE_CLASSES, "SAME_FAMILY_UNRESOLVED", "NO_MATCH"]])
    out = cards.claims(_cards(spark, sf_dir))
    return out.withColumn("verdict", F.get(classes, (k % 7).cast("int"))).withColumn("p", F.when(k % 4 == 0, 0.7).otherwise(0.95)).withColumn(
        "supported", F.array(F.concat(F.lit("Org/A"), (k % 6).cast("string")), F.concat(F.lit("other/src"), (k % 5).cast("string")))
    )


_CONSIST = f"""{_CARD}, v AS (SELECT *, ['EXACT_COPY', 'QUANTIZED_COPY', 'FINE_TUNE', 'SAME_LINEAGE', 'LIKELY_MERGE', 'SAME_FAMILY_UNRESOLVED', 'NO_MATCH'][doc_id % 7 + 1] AS verdict, CASE WHEN doc_id % 4 = 0 THEN 0.7 ELSE 0.95 END AS p,
  ['Org/A' || doc_id % 6, 'other/src' || doc_id % 5] AS supported FROM claim),
w AS (SELECT *, p >= 0.9 AND verdict <> 'NO_MATCH' AS detected, len(list_filter(base_models, lambda c : list_contains(list_transform(supported, lambda s : lower(c) = lower(s) OR split_part(lower(c), '/', 2) = split_part(lower(s), '/', 2)), true))) > 0 AS named FROM v)"""


@query("claim_match", f"WITH {_CONSIST} SELECT doc_id, named FROM w WHERE len(base_models) > 0")
def claim_match(spark, sf_dir):
    named = F.exists("base_models", lambda c: F.exists("supported", lambda s: cards.matches(c, s)))
    return _claimed(spark, sf_dir).filter(F.size("base_models") > 0).select(F.col("model_id").alias("doc_id"), named.alias("named"))


@query("consistency", f"WITH {_CONSIST} SELECT doc_id, CASE WHEN len(base_models) = 0 AND NOT from_scratch THEN 'NO_CLAIM' WHEN from_scratch AND detected THEN 'INCONSISTENT' WHEN len(base_models) > 0 AND detected AND named THEN 'CONSISTENT' WHEN len(base_models) > 0 AND detected THEN 'INCONSISTENT' ELSE 'UNVERIFIED' END AS status FROM w")
def consistency(spark, sf_dir):
    return cards.consistency(_claimed(spark, sf_dir)).select(F.col("model_id").alias("doc_id"), "status")


# stores: customers as indexed models, the larger half of the orders' customers as news


def _store(spark, sf_dir):
    return bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"), F.col("c_mktsegment").alias("family"), F.col("c_nationkey").alias("n_layers"))


def _news(spark, sf_dir):
    return bridge.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("model_id"), F.lit("news").alias("family"), F.col("s_nationkey").alias("n_layers"))


_STORE = "s AS (SELECT c_custkey AS model_id, c_mktsegment AS family, c_nationkey AS n_layers FROM customer), n AS (SELECT s_suppkey * 20 AS model_id, 'news' AS family, s_nationkey AS n_layers FROM supplier)"


@query("upsert", f"WITH {_STORE} SELECT * FROM s WHERE model_id NOT IN (SELECT model_id FROM n) UNION ALL SELECT * FROM n")
def upsert(spark, sf_dir):
    return store.upsert(_store(spark, sf_dir), _news(spark, sf_dir))


@query("remove", f"WITH {_STORE} SELECT * FROM s WHERE model_id NOT IN (SELECT model_id FROM n)")
def remove(spark, sf_dir):
    return store.remove(_store(spark, sf_dir), _news(spark, sf_dir))


@query("import_merge", f"WITH {_STORE} SELECT count(*) FILTER (model_id NOT IN (SELECT model_id FROM s)) AS added, count(*) FILTER (model_id IN (SELECT model_id FROM s)) AS skipped FROM n")
def import_merge(spark, sf_dir):
    return store.import_merge(_store(spark, sf_dir), _news(spark, sf_dir))[1]


@query("first_source_wins", f"WITH {_STORE}, u AS (SELECT *, 0 AS source FROM n UNION ALL SELECT *, 1 FROM s) SELECT model_id, arg_min(family, source) AS family, min(source)::INT AS source FROM u GROUP BY model_id")
def first_source_wins(spark, sf_dir):
    return store.first_source_wins([_news(spark, sf_dir), _store(spark, sf_dir)]).select("model_id", "family", "source")


@query("id_union", f"WITH {_STORE} SELECT model_id FROM s UNION SELECT model_id FROM n")
def id_union(spark, sf_dir):
    return _store(spark, sf_dir).select("model_id").union(_news(spark, sf_dir).select("model_id")).distinct()


_FOUND = "f AS (SELECT o_custkey * 3 AS model_id, o_orderkey % 97 AS rank FROM orders UNION ALL SELECT s_suppkey * 20, s_nationkey FROM supplier)"


def _found(spark, sf_dir):
    o = bridge.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("model_id"), (F.col("o_orderkey") % 97).alias("rank"))
    return o.union(bridge.table(spark, sf_dir, "supplier").select(F.col("s_suppkey") * 20, F.col("s_nationkey").cast("bigint")))


@query("rank_union_min", f"WITH {_FOUND} SELECT model_id, min(rank)::BIGINT AS rank FROM f GROUP BY model_id")
def rank_union_min(spark, sf_dir):
    return store.new_candidates(_found(spark, sf_dir), [])


@query("new_candidates", f"WITH {_STORE}, {_FOUND} SELECT model_id, min(rank)::BIGINT AS rank FROM f WHERE model_id NOT IN (SELECT model_id FROM s) GROUP BY model_id")
def new_candidates(spark, sf_dir):
    return store.new_candidates(_found(spark, sf_dir), [_store(spark, sf_dir)])


@query("growth_cap", f"WITH {_STORE}, {_FOUND} SELECT model_id, min(rank)::BIGINT AS rank FROM f WHERE model_id NOT IN (SELECT model_id FROM s) GROUP BY model_id ORDER BY min(rank), model_id LIMIT 8")
def growth_cap(spark, sf_dir):
    """At most eight new models a run: the cap is the feature."""
    return new_candidates(spark, sf_dir).orderBy("rank", "model_id").limit(8)


@query("drop_empty", "SELECT c_custkey FROM customer WHERE c_nationkey > 0 AND c_acctbal > 0")
def drop_empty(spark, sf_dir):
    """Models without layers or curves don't go on."""
    return bridge.table(spark, sf_dir, "customer").filter("c_nationkey > 0 and c_acctbal > 0").select("c_custkey")


@query("citation_split", "SELECT p_partkey, trim(split_part(p_name || ' -- ' || p_type, ' -- ', 1)) AS what, trim(split_part(p_name || ' -- ' || p_type, ' -- ', 2)) AS source FROM part")
def citation_split(spark, sf_dir):
    text = F.concat("p_name", F.lit(" -- "), "p_type")
    return bridge.table(spark, sf_dir, "part").select("p_partkey", *[F.trim(F.split_part(text, F.lit(" -- "), F.lit(i))).alias(n) for i, n in ((1, "what"), (2, "source"))])
