"""The queries over the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html, jaccard, language, quality, suffix, toxicity, urls, vectors
from .common import table


def _remainder(key: str, n: int):
    return F.crc32(F.col(key).cast("string")) % n


#: The rules of op3: (verdict, host/path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder("doc_id", 3) == 1
    model = toxicity.train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _remainder("doc_id", 5) == 0
    model = language.train(docs.filter(~held_out), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder("doc_id", 5) == 0
    model = quality.train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(tokens, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_urls": op3_urls,
    "op4_jaccard": op4_jaccard,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_suffix": op7_suffix,
    "op8_vectors": op8_vectors,
    "op9_bpe": op9_bpe,
    "op10_html": op10_html,
}

_RULE = "CASE " + " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND path LIKE '/{r.partition('/')[2]}%' THEN '{r}'" for _, r in sorted(URL_RULES, key=lambda x: -len(x[1]))
) + " END"
_VERDICT = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in URL_RULES) + " END"


def _chance(seen: str, of: str) -> str:
    out = f"{1 / urls.ALPHABET}::DOUBLE"
    for k in range(1, urls.ORDER + 2):
        out = f"(({seen}{k} + {urls.MASS}::DOUBLE * {out}) / ({of}{k} + {urls.MASS}::DOUBLE))"
    return out


_WIDE = ", ".join(f"coalesce(max({c}) FILTER (k = {k}), 0)::DOUBLE AS {c}{k}" for c in ("ca", "na", "cb", "nb") for k in range(1, urls.ORDER + 2))

#: SQL can't express the learnt models, the components over an exact similarity
#: join, token ids or block rules, and is too slow on whole tables for the
#: windows of op1 and the strings of op7: tests/llm holds those to brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_urls": f"""WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
ru AS (SELECT *, {_RULE} AS rule, translate(host || path, '123456789', '000000000') AS shape FROM hp),
ve AS (SELECT *, {_VERDICT} AS said FROM ru),
sh AS (SELECT shape, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM ve GROUP BY shape),
gr AS (SELECT shape, a, b, substr(repeat(chr(2), {urls.ORDER}) || shape || chr(3), i, {urls.ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, len(shape) + 2)) AS i FROM sh)),
co AS (SELECT gram, sum(a) AS a, sum(b) AS b FROM gr GROUP BY gram),
en AS (SELECT *, right(gram, k) AS tail FROM (SELECT *, unnest(range(1, {urls.ORDER + 2})) AS k FROM co)),
se AS (SELECT tail, sum(a) AS ca, sum(b) AS cb FROM en WHERE a > 0 OR b > 0 GROUP BY tail),
tt AS (SELECT left(tail, len(tail) - 1) AS context, len(tail) AS k, sum(ca) AS na, sum(cb) AS nb FROM se GROUP BY ALL),
wi AS (SELECT gram, {_WIDE} FROM (SELECT en.gram, en.k, ca, cb, na, nb FROM en LEFT JOIN se USING (tail) LEFT JOIN tt ON tt.context = left(en.tail, en.k - 1) AND tt.k = en.k) GROUP BY gram),
ra AS (SELECT gram, ln({_chance('ca', 'na')}) - ln({_chance('cb', 'nb')}) AS r FROM wi),
sc AS (SELECT shape, avg(r) AS ratio, any_value(gr.a) AS a, any_value(gr.b) AS b FROM gr JOIN ra USING (gram) GROUP BY shape),
mo AS (SELECT sum(a) AS na, sum(b) AS nb, sum(a * ratio) / sum(a) AS ma, sum(b * ratio) / sum(b) AS mb, sum(a * ratio * ratio) / sum(a) AS qa, sum(b * ratio * ratio) / sum(b) AS qb FROM sc),
cu AS (SELECT CASE WHEN na > 0 AND nb > 0 THEN (ma * db + mb * da) / (da + db) END AS cut FROM (SELECT *, sqrt(greatest(0, qa - ma * ma)) + 1e-6 AS da, sqrt(greatest(0, qb - mb * mb)) + 1e-6 AS db FROM mo))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN ratio < cut THEN 'block' ELSE 'allow' END) AS verdict FROM ve LEFT JOIN sc USING (shape), cu""",
}
