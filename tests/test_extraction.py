"""Planned reads, quantised files, configurations, claims and whole decompositions."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.operators import extract, fingerprint, mixture, sampling
from kinspark.session import LineageSession
from kinspark.sources import files, tensors

from .test_lineage import safetensors

HEADS, KEYS = 4, 2


def weights(seed, layers=4, hidden=64, base=None, noise=0.0):
    rng = np.random.default_rng(seed)
    shapes = {"self_attn.q_proj": (hidden, hidden), "self_attn.k_proj": (hidden // 2, hidden), "mlp.down_proj": (hidden, 2 * hidden), "input_layernorm": (hidden,)}
    out = {}
    for i in range(layers):
        for part, shape in shapes.items():
            name = f"model.layers.{i}.{part}.weight"
            fresh = rng.normal(0, 0.02 * (1 + 0.3 * rng.normal()), shape)
            out[name] = (fresh if base is None else base[name] + rng.normal(0, noise, shape)).astype(np.float32)
    out["model.norm.weight"] = (rng.normal(1, 0.1, hidden) if base is None else base["model.norm.weight"]).astype(np.float32)
    out["model.layers.0.self_attn.o_proj.weight"] = rng.normal(0, 0.02, (hidden, hidden)).astype(np.float32)  # in one layer alone
    return out


def checkpoint(folder, arrays, config=None, card=None):
    folder.mkdir()
    safetensors(folder / "model.safetensors", {k: ("F32", v) for k, v in arrays.items()})
    if config is not None:
        (folder / "config.json").write_text(config if isinstance(config, str) else json.dumps(config))
    if card:
        (folder / "README.md").write_text(card)
    return str(folder)


CONFIG = {"hidden_size": 64, "num_hidden_layers": 4, "num_attention_heads": HEADS, "num_key_value_heads": KEYS, "intermediate_size": 128, "torch_dtype": "float32"}


def gguf(path, arrays):
    """A quantised file, not quantised: rows of queries and keys stand as a converter puts them."""

    def text(s):
        return struct.pack("<Q", len(s)) + s.encode()

    def number(key, value):
        return text(key) + struct.pack("<II", 4, value)

    names = {"self_attn.q_proj": "attn_q", "self_attn.k_proj": "attn_k", "self_attn.o_proj": "attn_output", "mlp.down_proj": "ffn_down", "input_layernorm": "attn_norm"}
    meta = [text("general.architecture") + struct.pack("<I", 8) + text("llama"), number("general.file_type", 0), number("llama.embedding_length", 64), number("llama.block_count", 4)]
    meta += [number("llama.attention.head_count", HEADS), number("llama.attention.head_count_kv", KEYS), number("llama.feed_forward_length", 128)]
    infos, data = [], b""
    for name, x in arrays.items():
        if name == "model.norm.weight":
            stored = "output_norm.weight"
        else:
            _, _, layer, *part, _ = name.split(".")
            stored = f"blk.{layer}.{names['.'.join(part)]}.weight"
        for part, heads in (("attn_q", HEADS), ("attn_k", KEYS)):
            if f".{part}." in stored:
                x = x.reshape(heads, 2, x.shape[0] // heads // 2, -1).swapaxes(1, 2).reshape(x.shape)
        infos.append(text(stored) + struct.pack("<I", x.ndim) + b"".join(struct.pack("<Q", d) for d in x.shape[::-1]) + struct.pack("<IQ", 0, len(data)))
        data += x.tobytes() + b"\0" * (-x.nbytes % 32)
    head = b"GGUF" + struct.pack("<IQQ", 3, len(infos), len(meta)) + b"".join(meta) + b"".join(infos)
    path.write_bytes(head + b"\0" * (-len(head) % 32) + data)


def test_quantised_file_gives_the_same_fingerprint(spark, tmp_path):
    arrays = weights(1)
    one = checkpoint(tmp_path / "one", arrays, CONFIG)
    (tmp_path / "two").mkdir()
    gguf(tmp_path / "two" / "m-f32.gguf", arrays)
    (model, roles), (model2, roles2) = (extract.fingerprints(spark, p, "org/m") for p in (one, str(tmp_path / "two")))
    assert [model.first()[c] for c in ("n_layers", "hidden", "shape")] == [model2.first()[c] for c in ("n_layers", "hidden", "shape")] == [4, 64, "64x4x4x2x128"]
    a, b = ({r["role"]: r.asDict() for r in x.collect()} for x in (roles, roles2))
    assert sorted(a) == sorted(b) == ["attn.k", "attn.q", "mlp.down", "norm.final", "norm.in"]
    for role, row in a.items():
        for c in ("sigma", "norms", "vector", "pcs"):
            assert row[c] == pytest.approx(b[role][c], rel=1e-6)
    assert a["attn.q"]["spectra"][0] == pytest.approx(b["attn.q"]["spectra"][0], rel=1e-4) and len(a["attn.q"]["spectra"]) == 1
    x = arrays["model.layers.0.self_attn.q_proj.weight"]
    assert a["attn.q"]["sigma"][0] == pytest.approx(float(x.std(dtype=np.float64))) and a["attn.q"]["pcs"][:4096] == pytest.approx(x.ravel().tolist())
    assert a["attn.q"]["spectra"][0] == pytest.approx(np.linalg.svd(x, compute_uv=False)[:32].tolist(), rel=1e-3)
    assert a["norm.in"]["norms"][3] == pytest.approx(float(np.linalg.norm(arrays["model.layers.3.input_layernorm.weight"]))) and a["norm.final"]["norms"][0] > 0


def test_reads_follow_the_plan(spark, tmp_path):
    rng = np.random.default_rng(2)
    arrays = {f"model.layers.{i}.self_attn.q_proj.weight": rng.normal(size=(1500, 1000)).astype(np.float32) for i in range(2)}
    path = checkpoint(tmp_path / "m", arrays)
    cat = extract.mapped(spark, path, "m").withColumn("layer", F.col("layer").cast("int"))
    told = extract.bytes_read(cat).first()
    assert told["bytes_total"] == 2 * 6_000_000 and told["bytes_read"] < 0.8 * told["bytes_total"] and 2 < told["n_reads"] < 100
    got = extract.arrays(extract.pieces(cat)).filter("layer = 1 and part = 'sample'").first()["values"]
    plan = extract.plan(cat).filter("layer = 1 and part = 'sample'").orderBy("ord").collect()
    flat = arrays["model.layers.1.self_attn.q_proj.weight"].ravel()
    assert len(plan) > 20 and got == np.concatenate([flat[r["ord"] : r["ord"] + r["n_elems"]] for r in plan]).astype(float).tolist()
    band = extract.arrays(extract.pieces(cat)).filter("part = 'band'").collect()
    assert [(r["layer"], len(r["values"]), r["columns"]) for r in band] == [(0, sampling.SKETCH_ROWS * 1000, 1000)]
    start = next(k for k in range(1500) if flat is not None and arrays["model.layers.0.self_attn.q_proj.weight"][k, 0] == np.float32(band[0]["values"][0]))
    assert np.allclose(arrays["model.layers.0.self_attn.q_proj.weight"][start : start + 192].ravel(), band[0]["values"])


def test_signature_falls_back(spark, tmp_path):
    arrays = weights(3)
    path = checkpoint(tmp_path / "m", arrays, "{not json")
    row = extract.signature(extract.mapped(spark, path, "m"), path).first()
    assert (row["num_hidden_layers"], row["hidden_size"], row["num_key_value_heads"], row["dtype"]) == (4, 0, 0, "f32")
    other = checkpoint(tmp_path / "n", arrays, {"num_attention_heads": 8, "hidden_size": 64})
    row2 = extract.signature(extract.mapped(spark, other, "n"), other).first()
    assert (row2["num_key_value_heads"], row2["hidden_size"]) == (8, 64) and row2["inventory"] == row["inventory"]


def test_weight_files(tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.safetensors", "a.safetensors", "adapter_model.safetensors", "sub/c.safetensors"):
        (tmp_path / name).write_bytes(b"")
    assert [s.rsplit("/", 1)[-1] for s in tensors.shards(str(tmp_path))] == ["a.safetensors", "b.safetensors"]
    quant = tmp_path / "q"
    quant.mkdir()
    for name in ("m.Q4_K_M.gguf", "m.Q8_0-00001-of-00002.gguf", "m.Q8_0-00002-of-00002.gguf", "mmproj-f16.gguf"):
        (quant / name).write_bytes(b"")
    assert [s.rsplit("/", 1)[-1] for s in tensors.shards(str(quant))] == ["m.Q8_0-00001-of-00002.gguf", "m.Q8_0-00002-of-00002.gguf"]
    with pytest.raises(FileNotFoundError):
        tensors.shards(str(tmp_path / "none"))
    for raw in (b'{"a": 1}', gzip.compress(b'{"a": 1}')):
        (tmp_path / "x.json").write_bytes(raw)
        assert files.read_json(str(tmp_path / "x.json")) == {"a": 1}


def test_block_types_one_value_at_a_time():
    """The k types against loops over the published layout."""
    rng = np.random.default_rng(4)
    for kind in ("Q2_K", "Q3_K", "Q5_K", "IQ4_XS", "IQ4_NL"):
        elems, size = next((e, s) for n, e, s in files.BLOCK_TYPES.values() if n == kind)
        b = rng.integers(0, 256, size).astype(np.uint8)
        d, m, want = np.float16(0.25), np.float16(0.5), []
        raw = [int(x) for x in b]

        def put(at, value):
            b[at : at + 2] = np.frombuffer(value.tobytes(), np.uint8)

        if kind == "Q2_K":
            put(80, d), put(82, m)
            for n in range(2):
                for j in range(4):
                    for l in range(32):
                        s = raw[8 * n + 2 * j + l // 16]
                        want.append(float(d) * (s & 15) * (raw[16 + 32 * n + l] >> 2 * j & 3) - float(m) * (s >> 4))
        elif kind == "Q3_K":
            put(108, d)
            scale = [(raw[96 + k % 8] >> (4 * (k // 8)) & 15) | ((raw[104 + k % 4] >> (2 * (k // 4)) & 3) << 4) for k in range(16)]
            for n in range(2):
                for j in range(4):
                    for l in range(32):
                        q = (raw[32 + 32 * n + l] >> 2 * j & 3) - (0 if raw[l] >> (4 * n + j) & 1 else 4)
                        want.append(float(d) * (scale[8 * n + 2 * j + l // 16] - 32) * q)
        elif kind == "Q5_K":
            put(0, d), put(2, m)
            s = raw[4:16]
            for k in range(8):
                sc, mn = (s[k] & 63, s[k + 4] & 63) if k < 4 else ((s[k + 4] & 15) | (s[k - 4] >> 6 << 4), (s[k + 4] >> 4) | (s[k] >> 6 << 4))
                for l in range(32):
                    q = (raw[48 + 32 * (k // 2) + l] >> 4 * (k % 2) & 15) | (raw[16 + l] >> k & 1) << 4
                    want.append(float(d) * sc * q - float(m) * mn)
        elif kind == "IQ4_XS":
            put(0, d)
            high = raw[2] | raw[3] << 8
            for k in range(8):
                scale = ((raw[4 + k // 2] >> 4 * (k % 2) & 15) | (high >> 2 * k & 3) << 4) - 32
                want += [float(d) * scale * files.LEVELS[raw[8 + 16 * k + l % 16] >> 4 * (l // 16) & 15] for l in range(32)]
        else:
            put(0, d)
            want = [float(d) * files.LEVELS[raw[2 + l % 16] >> 4 * (l // 16) & 15] for l in range(32)]
        assert files.decode(b.tobytes(), kind).tolist() == pytest.approx(want, rel=1e-5) and len(want) == elems


def test_scan_reads_the_card_and_is_explained(spark, tmp_path):
    base = weights(5)
    s = LineageSession(spark, str(tmp_path / "store"))
    paths = {"org/base": checkpoint(tmp_path / "base", base, CONFIG), "new/other": checkpoint(tmp_path / "other", weights(6), CONFIG)}
    assert s.build(paths) == 2 and s.build(paths) == 0
    child = weights(7, base=base, noise=0.0005)
    liar = checkpoint(tmp_path / "liar", child, CONFIG, "---\nlicense: mit\n---\nTrained from scratch.")
    honest = checkpoint(tmp_path / "honest", child, CONFIG, "---\nbase_model: org/base\n---\n")
    got = {n: s.scan(p, f"me/{n}").first() for n, p in (("liar", liar), ("honest", honest))}
    assert (got["liar"]["status"], got["liar"]["exit_code"], got["liar"]["license"]) == ("INCONSISTENT", 3, "mit")
    assert (got["honest"]["status"], got["honest"]["exit_code"], got["honest"]["best"]) == ("CONSISTENT", 0, "org/base")
    s.scan(honest, "me/liar")
    assert s.explain("me/liar").first()["status"] == "CONSISTENT" and s.explain("me/none").count() == 0
    assert set(s.neutral()) == {"sigma_r", "vector_cos", "pcs_cos", "spectra_r"}
    s.export_json(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "models")).count() == 2
    other = checkpoint(tmp_path / "wide", weights(8), CONFIG | {"num_attention_heads": 8})
    assert {r["ruled_out"] for r in s.compare(other, "me/wide").collect()} == {"incompatible tensor shapes"}
    with pytest.raises(ValueError):
        s.add(other, "../up")


def test_decompose_whole(spark, tmp_path):
    a, b, c = (weights(k) for k in (11, 12, 13))
    mix = {k: (0.6 * a[k] + 0.4 * b[k]).astype(np.float32) for k in a}
    p = {n: checkpoint(tmp_path / n, x, CONFIG) for n, x in (("a", a), ("b", b), ("c", c), ("mix", mix), ("near", weights(14, base=a, noise=1e-9)))}
    s = LineageSession(spark, str(tmp_path / "store"))
    s.add(p["a"], "org/a")
    got = s.decompose(p["mix"], ["org/a", p["b"], p["c"]]).first()
    assert got["alphas"] == pytest.approx([0.6, 0.4, 0.0], abs=1e-4) and (got["summary"], got["notes"], got["rank"]) == ("MERGE", [], 2)
    assert got["recon_cos"] > 0.9999 and got["gain"] > 0.99 and set(got["by_role"]) >= {"attn.q", "attn.k", "mlp.down"} and len(got["by_layer"]) == 4
    assert all(x == pytest.approx([0.6, 0.4, 0.0], abs=1e-3) for x in [*got["by_role"].values(), *got["by_layer"]])
    with_base = s.decompose(p["mix"], [p["b"]], base="org/a").first()
    assert with_base["alphas"] == pytest.approx([0.4, 0.6], abs=1e-4) and with_base["summary"] == "SINGLE_PARENT"
    same = s.decompose(p["mix"], [p["near"], p["b"]], base="org/a").first()
    assert "interchangeable candidates" in same["notes"]
    for bad in (["org/a"], ["org/a", "org/a"], ["org/a", p["mix"]], ["org/a", "no/where"]):
        with pytest.raises(ValueError):
            s.decompose(p["mix"], bad)
    deeper = checkpoint(tmp_path / "deep", weights(15, layers=5), CONFIG | {"num_hidden_layers": 5})
    with pytest.raises(ValueError):
        s.decompose(p["mix"], ["org/a", deeper])


def test_decomposition_of_nearly_equal_candidates(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 3))
    x[:, 1] = x[:, 0] + 1e-4 * rng.normal(size=500)
    y = x @ [0.5, 0.2, 0.3]
    rows = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "y double, x array<double>")
    got = mixture.decomposition(rows, [], "y", "x").first()
    d = x[:, :2] - x[:, 2:]
    b = np.linalg.lstsq(d, y - x[:, 2], rcond=None)[0]
    assert got["alphas"] == pytest.approx([*b, 1 - b.sum()], abs=1e-6) and got["parallel"] == 1 and got["rss"] < 1e-9


def test_spectra_against_exact_values(spark):
    rng = np.random.default_rng(10)
    big = rng.normal(size=(192, 120)) @ np.diag(0.9 ** np.arange(120))
    rows = [("m", "attn.q", 0, big.ravel().tolist()), ("m", "attn.q", 1, [1.0]), ("m", "attn.q", 4, rng.normal(size=40).tolist())]
    got = {r["layer"]: r["svals"] for r in fingerprint.spectra(spark.createDataFrame(rows, "model string, role string, layer int, values array<double>"), 120).collect()}
    assert set(got) == {0, 4} and got[4] == [] and got[0] == pytest.approx(np.linalg.svd(big, compute_uv=False)[:32].tolist(), rel=1e-3)
