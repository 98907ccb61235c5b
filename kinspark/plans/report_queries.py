"""Queries over what people read: gaps, cards, logs, report rows, dates and escaped text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import report, sampling
from . import bridge
from .mixture_queries import SAMPLES, _alphas, _fit2
from .registry import query
from .zoo_queries import PAIRS, _verdicts


@query(
    "roles_by_layer",
    f"WITH {bridge.CURVE}, d AS (SELECT model, max(layer) AS last FROM curve GROUP BY model), r AS (SELECT DISTINCT model, role FROM curve), h AS (SELECT DISTINCT model, role, layer FROM curve), "
    "g AS (SELECT model, role, unnest(range(last + 1))::INT AS layer FROM r JOIN d USING (model)) SELECT g.model, g.role, g.layer, h.layer IS NOT NULL AS present FROM g LEFT JOIN h ON h.model = g.model AND h.role = g.role AND h.layer = g.layer",
)
def roles_by_layer(spark, sf_dir):
    return report.roles_by_layer(bridge.curve_rows(spark, sf_dir).select("model", "role", "layer"))


@query("float32", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice * l_discount)::FLOAT::DOUBLE AS value FROM lineitem")
def float32(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", expr.float32(F.col("l_extendedprice") * F.col("l_discount")).alias("value"))


@query("day_of", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def day_of(spark, sf_dir):
    return bridge.table(spark, sf_dir, "events").select("event_id", expr.day("ts").alias("day"), expr.stamp("ts").alias("stamp"))


@query("latest_scan", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_scan(spark, sf_dir):
    return report.latest(bridge.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("html_escape", "SELECT p_partkey, replace(replace(replace(replace('<' || p_name || '> & \"' || p_brand || '\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS label FROM part")
def html_escape(spark, sf_dir):
    label = F.concat(F.lit("<"), F.col("p_name"), F.lit('> & "'), F.col("p_brand"), F.lit('"'))
    return bridge.table(spark, sf_dir, "part").select("p_partkey", expr.html_escape(label).alias("label"))


@query("byte_totals", f"SELECT p_partkey % 50 AS model, sum(p_size * 100000 * 4)::BIGINT AS total_bytes, sum(least(p_size * 100000, {sampling.BLOCKS * sampling.BLOCK_LEN}) * 4)::BIGINT AS bytes_read FROM part GROUP BY 1")
def byte_totals(spark, sf_dir):
    numel = F.col("p_size").cast("bigint") * 100000
    part = bridge.table(spark, sf_dir, "part").withColumn("model", F.col("p_partkey") % 50)
    return report.byte_totals(part, ["model"], numel * 4, F.least(numel, F.lit(sampling.BLOCKS * sampling.BLOCK_LEN)) * 4)


@query(
    "merge_cards",
    f"WITH {SAMPLES}, {_fit2('target')}, w AS (SELECT f.target, z.parent, f.a AS alpha, z.kind FROM f2g f JOIN zoo z ON z.model_id = f.target UNION ALL SELECT f.target, z.parent2, 1 - f.a, z.kind FROM f2g f JOIN zoo z ON z.model_id = f.target) "
    "SELECT target, string_agg(parent::VARCHAR, ' > ' ORDER BY -round(alpha, 6), parent::VARCHAR) AS parents, round(max(round(alpha, 3)), 3) AS heaviest FROM w GROUP BY target",
)
def merge_cards(spark, sf_dir):
    cards = report.merge_cards(_alphas(spark, sf_dir).withColumn("alpha", F.round("alpha", 6)), "target", "parent", "alpha")
    return cards.select("target", F.array_join(F.transform("parents", lambda s: s["id"]), " > ").alias("parents"), F.array_max(F.transform("parents", lambda s: s["alpha"])).alias("heaviest"))


@query("report_rows", f"WITH {PAIRS} SELECT suspect, '<tr><td>model &amp; ' || suspect || '</td><td>' || verdict || '</td><td>' || coalesce(best::VARCHAR, '-') || '</td><td>' || coalesce(floor(round(p, 6) * 100)::INT || ' %', '-') || '</td></tr>' AS html FROM verdicts")
def report_rows(spark, sf_dir):
    label = F.concat(F.lit("model & "), F.col("suspect").cast("string"))
    return _verdicts(spark, sf_dir).select("suspect", report.report_row(label, F.col("verdict"), F.col("best").cast("string"), F.round("p", 6)).alias("html"))
