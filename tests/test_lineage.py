"""Constants, degenerate input, decision table, store, sources and streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.functions import expr, names
from kinspark.operators import claims, extract, graph, metrics, mixture, sampling, score, store
from kinspark.plans import catalogue, zoo_queries
from kinspark.session import LineageSession
from kinspark.sources import files, tensors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "parts, value",
    [
        ((20260704, "attn.q", 0), 11159272120784529451), ((20260704, "mlp.down", 31), 5960502462241486606), ((20260704, "attn.k", 7), 4034366045655373962),
        (("a",), 620345593008815561), ((1, "x"), 15352260893659086084),
    ],
)
def test_fnv(spark, parts, value):
    assert int(one(spark, expr.fnv1a(*map(F.lit, parts)))) == value


@pytest.mark.parametrize(
    "args, offsets",
    [
        ((10_000_000, 4, 1000, 7), [1293880, 2315479, 4181822, 8318041]), ((10_000, 8, 100, 1), [999, 2663, 3704, 3897, 7059, 8320, 8609, 9308]), ((1000, 4, 1000, 7), [0]),
    ],
)
def test_lcg(spark, args, offsets):
    n, blocks, size, seed = args
    assert one(spark, expr.lcg_offsets(F.lit(n).cast("bigint"), F.lit(blocks), F.lit(size).cast("bigint"), F.lit(seed))) == offsets


def test_large_seed_and_band(spark):
    seed = F.lit("11159272120784529451").cast("decimal(20,0)")
    assert one(spark, expr.lcg_offsets(F.lit(4096 * 4096).cast("bigint"), F.lit(32), F.lit(16384).cast("bigint"), seed))[:4] == [1242655, 2264351, 3129317, 3932755]
    assert one(spark, sampling.sketch_band(F.lit(4096).cast("bigint"), seed)) == 61


@pytest.mark.parametrize("a, b, r, c", [([1.0, 2.0, 3.0], [2.0, 4.0, 6.0], 1.0, 1.0), ([1.0, 1.0, 1.0], [1.0, 2.0, 3.0], 0.0, 0.9258), ([1.0, 2.0], [2.0, 1.0], 0.0, 0.8), ([1.0, 2.0, 3.0], [1.0, 2.0], 0.0, 0.0), ([], [], 0.0, 0.0), ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 0.0, 0.0)])
def test_guarded_similarity(spark, a, b, r, c):
    x, y = (F.array(*[F.lit(v) for v in s]).cast("array<double>") for s in (a, b))
    assert one(spark, expr.pearson(x, y)) == pytest.approx(r, abs=1e-3)
    assert one(spark, expr.cosine(x, y)) == pytest.approx(c, abs=1e-3)


CASES = [
    ([(1.0, 1.0, 1.0, 1.0, "a", True)], "EXACT_COPY", 0.998499), ([(1.0, 1.0, 1.0, 1.0, "a", False)], "QUANTIZED_COPY", 0.998499), ([(1.0, 1.0, 0.995, 1.0, "a", False)], "FINE_TUNE", 0.998465),
    ([(0.97, 1.0, 0.45, 1.0, "a", False)], "SAME_LINEAGE", 0.979367), ([(0.85, 0.95, 0.15, 0.97, "a", False)], "SAME_FAMILY_UNRESOLVED", 0.851321), ([(0.2, 0.9, 0.0, 0.95, "a", False)], "NO_MATCH", 0.069138),
    ([(1.0, 1.0, 0.992, 1.0, "a", False), (1.0, 1.0, 0.99, 1.0, "a", False)], "SAME_FAMILY_UNRESOLVED", 0.998444), ([(0.99, 1.0, 0.7, 1.0, "a", False), (0.99, 1.0, 0.68, 1.0, "b", False)], "LIKELY_MERGE", None),
    ([(1.0, 1.0, 0.999, 1.0, "a", False), (0.9, 1.0, 0.4, 1.0, "a", False)], "FINE_TUNE", 0.9985), ([], "INSUFFICIENT", None),
]


@pytest.mark.parametrize("rows, verdict, p", CASES)
def test_decision_table(spark, rows, verdict, p):
    made = [("s", f"c{i}", True, True, r[5], True, "", "", r[4], *r[:4]) for i, r in enumerate(rows)]
    schema = "suspect string, candidate string, layers_match boolean, shape_compatible boolean, inventory_match boolean, seed_match boolean, suspect_dtype string, candidate_dtype string, family string, sigma_r double, vector_cos double, pcs_cos double, spectra_r double"
    ranked = score.rank(score.score(spark.createDataFrame(made, schema)))
    got = score.judge(spark.createDataFrame([("s",)], "model_id string"), ranked).first()
    assert got["verdict"] == verdict
    if p:
        assert got["p"] == pytest.approx(p, abs=2e-5)


def test_layer_mismatch_is_no_match(spark):
    schema = "suspect string, candidate string, layers_match boolean, shape_compatible boolean, inventory_match boolean, seed_match boolean, suspect_dtype string, candidate_dtype string, family string, sigma_r double, vector_cos double, pcs_cos double, spectra_r double"
    row = spark.createDataFrame([("s", "c", False, True, False, True, "", "", "a", None, None, None, None)], schema)
    scored = score.score(row)
    assert scored.first()["ruled_out"] == "layer count mismatch"
    assert score.judge(spark.createDataFrame([("s",)], "model_id string"), score.rank(scored)).first()["verdict"] == "NO_MATCH"


def test_cards(spark):
    cards = [
        ("scalar", "---\nbase_model: org/base\nlicense: 'mit'\n---\nTuned."), ("inline", "---\nbase_model: [a/b, \"c/d\"]\n---\n"), ("block", "---\n# x\nbase_model:\n  - a/b\n  - 'c/d'\ntags: []\n---\nPre-trained from scratch."),
        ("front", "---\nnote: trained from scratch\n---\nNothing."), ("none", "Not a fine-tune of any model."), ("null", None),
    ]
    got = {r["model_id"]: r for r in claims.claims(spark.createDataFrame(cards, "model_id string, card string")).collect()}
    assert got["scalar"]["base_models"] == ["org/base"] and got["scalar"]["license"] == "mit"
    assert got["inline"]["base_models"] == got["block"]["base_models"] == ["a/b", "c/d"]
    assert [got[k]["from_scratch"] for k in ("scalar", "block", "front", "none", "null")] == [False, True, False, True, False]
    assert not got["null"]["has_claim"]


def test_metrics_with_ties(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 20, 500) / 20, rng.integers(0, 2, 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    wins = np.sign(s[y == 1][:, None] - s[y == 0][None]).mean() / 2 + 0.5
    assert metrics.auroc(df, "s", "y").first()[0] == pytest.approx(wins)
    assert metrics.tpr_at_fpr(df.filter("y = 1"), "s", "y").first()["threshold"] == 1.0


def test_calibrator_fits_more_pairs_than_are_gathered(spark):
    """The same descent over gathered pairs, over pairs that stay where they are, and in numpy; repeats count."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.uniform(-1, 1, (300, 4)), rng.integers(1, 4, 300), axis=0)
    y = (x @ [3.0, 1.0, -2.0, 0.5] + rng.normal(0, 0.5, len(x)) > 0).astype(float)
    rows = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], ", ".join(f"{f} double" for f in score.FEATURES) + ", y int").repartition(3)
    w, b = np.zeros(4), 0.0
    for _ in range(20):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = np.maximum(0.0, w - 0.5 * (x.T @ error / len(x) + 1e-3 * w)), b - 0.5 * error.mean()
    for most in (200_000, 100):
        got = {r["feature"]: r["weight"] for r in score.fit(rows, "y", epochs=20, most=most).collect()}
        assert list(got.values()) == pytest.approx([*w, b], abs=1e-9) and list(got) == [*score.FEATURES, "intercept"]
    assert [r["weight"] for r in score.fit(rows.filter("false"), "y", epochs=20, most=0).collect()] == [0.0] * 5


def test_calibrator_query_takes_all_epochs(spark, tmp_path):
    """The query's weights are those of 4000 epochs over its labelled pairs, and the same if the pairs stay where they are."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=64)], i % 10) for i in range(70)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = zoo_queries._truth(spark, str(tmp_path)).select(*[F.coalesce(f, F.lit(score.NEUTRAL[f])).alias(f) for f in score.FEATURES], "y").localCheckpoint()
    held = np.array(pairs.collect(), float)
    x, y, w, b = held[:, :4], held[:, 4], np.zeros(4), 0.0
    for _ in range(4000):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = np.maximum(0.0, w - 0.5 * (x.T @ error / len(x) + 1e-3 * w)), b - 0.5 * error.mean()
    got = catalogue.QUERIES["calibrator_fit"](spark, str(tmp_path)).collect()
    assert [r["weight"] for r in got] == pytest.approx([*w, b], abs=1e-9)
    assert [r["weight"] for r in score.fit(pairs, "y", most=100).collect()] == pytest.approx([*w, b], abs=1e-9)


def test_mixture_recovers_weights(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = x @ [0.5, 0.3, 0.2]
    rows = spark.createDataFrame([("t", float(b), *map(float, a)) for a, b in zip(x, y)], "t string, y double, a double, b double, c double")
    fit = mixture.fit(rows, ["t"], "y", ["a", "b", "c"]).first()
    assert [fit[f"a_{i}"] for i in range(3)] == pytest.approx([0.5, 0.3, 0.2]) and fit["gain"] == pytest.approx(1.0)
    many = mixture.fit_any(rows.select("t", "y", F.array("a", "b", "c").alias("x")), ["t"], "y", "x").first()
    assert many["alphas"] == pytest.approx([0.5, 0.3, 0.2]) and many["rank"] == 2
    same = mixture.fit(rows.withColumn("b", F.col("a")), ["t"], "y", ["a", "b"]).first()
    assert same["a_0"] is None


def test_ranges(spark):
    r = spark.createDataFrame([(1, 100, 200), (1, 0, 50), (1, 210, 300), (2, 0, 10), (2, 40, 50)], "g int, byte_start bigint, byte_end bigint")
    got = sorted(tuple(x)[:3] for x in sampling.coalesce_ranges(r, ["g"], gap=16).collect())
    assert got == [(1, 0, 50), (1, 100, 300), (2, 0, 10), (2, 40, 50)]


def test_undetected_and_documented(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (3, 4, 0.1)], "a int, b int, p double")
    truth = spark.createDataFrame([(2, 1, "tuned"), (9, 8, "merge")], "suspect int, parent int, kind string")
    assert {(r["a"], r["b"]) for r in graph.undetected(pairs, truth).collect()} == {(8, 9)}
    assert {(r["a"], r["child"]) for r in graph.edges(pairs, truth).collect()} == {(1, 2)}


def safetensors(path, arrays):
    header, data, at = {"__metadata__": {}}, b"", 0
    for name, (dtype, x) in arrays.items():
        raw = x.tobytes()
        header[name] = {"dtype": dtype, "shape": list(x.shape), "data_offsets": [at, at + len(raw)]}
        data, at = data + raw, at + len(raw)
    text = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(text)) + text + data)


def checkpoint(folder, seed, base=None, noise=0.0, layers=8):
    rng = np.random.default_rng(seed)
    arrays = {}
    for i in range(layers):
        for part in ("self_attn.q_proj", "self_attn.k_proj", "mlp.down_proj"):
            x = rng.normal(0, 0.02 * (1 + 0.3 * rng.normal()), (16, 32)).astype(np.float32)
            name = f"model.layers.{i}.{part}.weight"
            arrays[name] = ("F32", x if base is None else (base[name][1] + rng.normal(0, noise, x.shape)).astype(np.float32))
    folder.mkdir()
    safetensors(folder / "model.safetensors", arrays)
    return arrays


def test_catalog_and_blocks(spark, tmp_path):
    arrays = checkpoint(tmp_path / "m", 0)
    tensors.register(spark)
    cat = spark.read.format("tensors").option("path", str(tmp_path / "m")).load()
    assert cat.count() == len(arrays) and cat.agg(F.sum("numel")).first()[0] == 8 * 3 * 512
    name = "model.layers.3.mlp.down_proj.weight"
    rows = spark.read.format("tensors").option("path", str(tmp_path / "m")).option("mode", "blocks").option("block_len", 100).load().filter(F.col("tensor") == name)
    got = np.concatenate([r["values"] for r in rows.orderBy("elem_start").collect()])
    assert np.allclose(got, arrays[name][1].ravel())
    (tmp_path / "bad.safetensors").write_bytes(b"\xff" * 32)
    with pytest.raises(ValueError):
        files.safetensors_catalog(str(tmp_path / "bad.safetensors"))


def test_decoders():
    x = np.array([1.0, -1.0], np.float32)
    assert files.decode(np.array([0x3F80, 0xBF80], "<u2").tobytes(), "BF16").tolist() == x.tolist()
    rng = np.random.default_rng(0)
    v = rng.normal(size=320).astype(np.float32).reshape(-1, 32)
    d = (np.abs(v).max(axis=1, keepdims=True) / 127).astype("<f2")
    q = np.round(v / d.astype(np.float32)).astype(np.int8)
    raw = b"".join(a.tobytes() + b.tobytes() for a, b in zip(d, q))
    assert np.allclose(files.decode(raw, "Q8_0").reshape(-1, 32), v, atol=0.02)
    q4 = rng.integers(0, 16, (4, 32)).astype(np.uint8)
    raw = b"".join(np.float16(0.5).tobytes() + (row[:16] | (row[16:] << 4)).tobytes() for row in q4)
    assert np.allclose(files.decode(raw, "Q4_0").reshape(4, 32), 0.5 * (q4.astype(float) - 8))
    for kind, (name, elems, size) in files.BLOCK_TYPES.items():
        assert len(files.decode(bytes(size * 3), name)) == 3 * elems


def test_session_finds_the_parent(spark, tmp_path):
    base = checkpoint(tmp_path / "base", 1)
    checkpoint(tmp_path / "other", 2)
    checkpoint(tmp_path / "child", 3, base, 0.001)
    s = LineageSession(spark, str(tmp_path / "store"))
    s.add(str(tmp_path / "base"), "org/base")
    s.add(str(tmp_path / "other"), "new/other")
    got = s.scan(str(tmp_path / "child"), "me/child").first()
    assert got["best"] == "org/base" and got["verdict"] in ("FINE_TUNE", "SAME_LINEAGE", "QUANTIZED_COPY") and got["exit_code"] == 0
    weights = s.decompose(str(tmp_path / "child"), ["org/base", "new/other"]).first()["alphas"]
    assert weights == pytest.approx([1.0, 0.0], abs=0.05)
    with pytest.raises(ValueError):
        s.add(str(tmp_path / "base"), "org/base")
    assert s.models.remove("new/other") and not s.models.remove("new/other")


def test_growth_adds_each_model_once(spark, tmp_path):
    from kinspark.streaming import growth

    spark.createDataFrame([("a", 8, "f"), ("b", 8, "f"), ("a", 8, "f")], "model_id string, n_layers int, family string").write.parquet(str(tmp_path / "in"))
    kept = store.ReferenceStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        growth.grow(spark, str(tmp_path / "in"), "model_id string, n_layers int, family string", kept, str(tmp_path / "ck")).awaitTermination()
    assert kept.models().count() == 2


def test_names(spark):
    got = spark.createDataFrame([("blk.3.attn_q.bias",), ("model.norm.weight",), ("xmodel.norm.weight",), ("model.layers.x.mlp.fc1.weight",)], "n string").select(names.canonical("n").alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [(3, "attn.q.bias"), (None, "norm.final"), (None, None), (None, None)]


def test_command_line(spark, tmp_path, capsys):
    from kinspark.__main__ import parser, run

    checkpoint(tmp_path / "m", 5, layers=4)
    session, store_path = LineageSession(spark, str(tmp_path / "s")), str(tmp_path / "s")
    call = lambda *a: run(session, parser().parse_args(["--store", store_path, *a]))
    assert call("add", str(tmp_path / "m"), "org/m") == 0
    assert call("export", str(tmp_path / "out")) == 0
    assert call("scan", str(tmp_path / "m"), "copy/m") == 0
    assert "COPY" in capsys.readouterr().out
    assert call("import", str(tmp_path / "out")) == 0 and "added 0, skipped 1" in capsys.readouterr().out
    assert call("remove", "org/m") == 0 and call("remove", "org/m") == 1
