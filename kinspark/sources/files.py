"""Byte ranges of checkpoint files, on local disks or any store that Arrow opens by URI."""

from __future__ import annotations

import json
import struct


class RangeFile:
    """Random reads from one file."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        raw = self.file.read_at(length, start)
        if len(raw) != length:
            raise ValueError(f"file ends before byte {start + length}")
        return raw


def list_files(path: str) -> list[str]:
    """All files under a folder, sorted; a file is itself."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(scheme + f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File)


def read_text(path: str) -> str | None:
    """A small file as text; None if there is none."""
    try:
        f = RangeFile(path)
    except FileNotFoundError:
        return None
    return f.read(0, f.size).decode("utf-8", "replace")


def read_json(path: str) -> dict:
    """A JSON file, gzipped or not, whatever its name says."""
    import gzip

    f = RangeFile(path)
    raw = f.read(0, f.size)
    return json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)


#: Element types of the header format: numpy code and bytes (fixed values); 8-bit floats stay raw bytes.
DTYPES = {
    "F64": ("<f8", 8), "F32": ("<f4", 4), "F16": ("<f2", 2), "BF16": ("<u2", 2), "I64": ("<i8", 8), "I32": ("<i4", 4), "I16": ("<i2", 2), "I8": ("<i1", 1),
    "U8": ("<u1", 1), "BOOL": ("<u1", 1), "F8_E4M3": ("<u1", 1), "F8_E5M2": ("<u1", 1),
}
MAX_HEADER = 100 * 1024 * 1024
#: Block types of the quantised format by number: name, elements, bytes (fixed values).
BLOCK_TYPES = {
    0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24), 8: ("Q8_0", 32, 34),
    10: ("Q2_K", 256, 84), 11: ("Q3_K", 256, 110), 12: ("Q4_K", 256, 144), 13: ("Q5_K", 256, 176), 14: ("Q6_K", 256, 210), 20: ("IQ4_NL", 32, 18), 23: ("IQ4_XS", 256, 136), 24: ("I8", 1, 1), 25: ("I16", 1, 2), 26: ("I32", 1, 4), 27: ("I64", 1, 8), 28: ("F64", 1, 8), 30: ("BF16", 1, 2),
}
#: The sixteen levels of the non-linear four-bit types, and the file types by number (fixed values).
LEVELS = [-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113]
FILE_TYPES = {
    0: "f32", 1: "f16", 2: "q4_0", 3: "q4_1", 7: "q8_0", 8: "q5_0", 9: "q5_1", 10: "q2_k", 11: "q3_k_s", 12: "q3_k_m", 13: "q3_k_l", 14: "q4_k_s", 15: "q4_k_m",
    16: "q5_k_s", 17: "q5_k_m", 18: "q6_k", 19: "iq2_xxs", 20: "iq2_xs", 21: "q2_k_s", 22: "iq3_xs", 23: "iq3_xxs", 24: "iq1_s", 25: "iq4_nl", 26: "iq3_s",
    27: "iq3_m", 28: "iq2_s", 29: "iq2_m", 30: "iq4_xs", 31: "iq1_m", 32: "bf16",
}
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}


def safetensors_catalog(path: str) -> list[dict]:
    """The tensors of a file: name, dtype, shape, absolute byte range, block layout."""
    f = RangeFile(path)
    if f.size < 8:
        raise ValueError(f"{path}: too short")
    n = struct.unpack("<Q", f.read(0, 8))[0]
    if not 0 < n <= min(MAX_HEADER, f.size - 8):
        raise ValueError(f"{path}: implausible header length {n}")
    try:
        header = json.loads(f.read(8, n).decode("utf-8"))
    except ValueError as e:
        raise ValueError(f"{path}: bad header") from e
    out = []
    for name, entry in header.items():
        if name == "__metadata__":
            continue
        if entry["dtype"] not in DTYPES:
            raise ValueError(f"{path}: unsupported dtype {entry['dtype']} of {name}")
        a, b = entry["data_offsets"]
        out.append(row(path, name, entry["dtype"], entry["shape"], 8 + n + a, 8 + n + b, 1, DTYPES[entry["dtype"]][1]))
    return out


def row(path, name, dtype, shape, start, end, block_elems, block_bytes, perm_heads=0) -> dict:
    numel = 1
    for d in shape:
        numel *= d
    return {
        "shard": path, "tensor": name, "dtype": dtype, "shape": [int(d) for d in shape], "numel": numel, "byte_start": start, "byte_end": end,
        "block_elems": block_elems, "block_bytes": block_bytes, "perm_heads": perm_heads,
    }


class Cursor:
    """Little-endian values from the head of a file, fetched a megabyte at a time."""

    def __init__(self, path: str):
        self.f, self.at, self.held, self.first = RangeFile(path), 0, b"", 0

    def take(self, n: int) -> bytes:
        if self.at + n > self.first + len(self.held):
            size = min(max(n, 1 << 20), self.f.size - self.at)
            if size < n:
                raise ValueError("file ends inside its header")
            self.first, self.held = self.at, self.f.read(self.at, size)
        a = self.at - self.first
        self.at += n
        return self.held[a : a + n]

    def value(self, fmt: str):
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]

    def text(self) -> str:
        return self.take(self.value("<Q")).decode("utf-8", "replace")


def gguf_header(path: str) -> tuple[dict, list[dict]]:
    """Metadata (arrays of over 4096 values by their length alone) and tensors of a quantised file, version 2 or 3."""
    c = Cursor(path)
    if c.take(4) != b"GGUF":
        raise ValueError(f"{path}: bad magic")
    if c.value("<I") not in (2, 3):
        raise ValueError(f"{path}: unsupported version")
    tensors, pairs, meta = c.value("<Q"), c.value("<Q"), {}

    def read(kind: int):
        if kind == 8:
            return c.text()
        if kind != 9:
            return c.value(SCALARS[kind])
        inner, count = c.value("<I"), c.value("<Q")
        values = [read(inner) for _ in range(count)] if inner in (8, 9) else list(struct.unpack(f"<{count}{SCALARS[inner][1]}", c.take(count * struct.calcsize(SCALARS[inner]))))
        return values if count <= 4096 else {"length": count}

    for _ in range(pairs):
        key = c.text()
        meta[key] = read(c.value("<I"))
    infos = []
    for _ in range(tensors):
        name = c.text()
        shape = [c.value("<Q") for _ in range(c.value("<I"))]
        infos.append((name, shape, c.value("<I"), c.value("<Q")))
    align = int(meta.get("general.alignment", 32))
    start, out = -(-c.at // align) * align, []
    arch = meta.get("general.architecture", "")
    heads = {"attn_q": meta.get(f"{arch}.attention.head_count", 0), "attn_k": meta.get(f"{arch}.attention.head_count_kv", meta.get(f"{arch}.attention.head_count", 0))}
    for name, shape, kind, offset in infos:
        if kind not in BLOCK_TYPES:
            raise ValueError(f"{path}: unsupported block type {kind} of {name}")
        dtype, elems, size = BLOCK_TYPES[kind]
        numel = 1
        for d in shape:
            numel *= d
        if numel % elems:
            raise ValueError(f"{path}: {name} isn't made of whole blocks")
        part = name.split(".")[2] if name.startswith("blk.") else ""
        permuted, rows = heads.get(part, 0) if arch == "llama" else 0, shape[-1]
        permuted = permuted[0] if isinstance(permuted, list) and permuted else permuted or 0
        if permuted and (rows % permuted or rows // permuted % 2):
            permuted = 0
        out.append(row(path, name, dtype, shape[::-1], start + offset, start + offset + numel // elems * size, elems, size, int(permuted or 0)))
    return meta, out


def gguf_config(path: str) -> dict:
    """What a quantised file says of its model, by the names that configurations use; missing values are left out."""
    meta, tensors = gguf_header(path)
    arch = meta.get("general.architecture", "")

    def number(key: str) -> int:
        value = meta.get(f"{arch}.{key}", 0)
        value = (value[0] if value else 0) if isinstance(value, list) else value
        return int(value) if isinstance(value, (int, float)) else 0

    tokens = meta.get("tokenizer.ggml.tokens", [])
    vocabulary = number("vocab_size") or (tokens["length"] if isinstance(tokens, dict) else len(tokens))
    embedding = next((t["shape"][0] for t in tensors if t["tensor"] == "token_embd.weight"), 0)
    matrices = [t["dtype"].lower() for t in tensors if len(t["shape"]) == 2]
    label = FILE_TYPES.get(meta.get("general.file_type")) or (max(dict.fromkeys(matrices), key=matrices.count) if matrices else "")
    found = {
        "hidden_size": number("embedding_length"), "num_hidden_layers": number("block_count"), "num_attention_heads": number("attention.head_count"),
        "num_key_value_heads": number("attention.head_count_kv") or number("attention.head_count"), "intermediate_size": number("feed_forward_length"),
        "vocab_size": vocabulary or embedding, "torch_dtype": label,
    }
    return {k: v for k, v in found.items() if v}


def decode(raw: bytes, dtype: str):
    """Whole blocks as a flat float array (64-bit floats stay so)."""
    import numpy as np

    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    if dtype in DTYPES:
        x = np.frombuffer(raw, DTYPES[dtype][0])
        return x if dtype == "F64" else x.astype(np.float32)
    elems, size = next((e, s) for n, e, s in BLOCK_TYPES.values() if n == dtype)
    b = np.frombuffer(raw, np.uint8).reshape(-1, size)

    def half(at: int):
        return b[:, at : at + 2].copy().view("<f2").astype(np.float32)

    def nibbles(q):
        return np.concatenate([q & 15, q >> 4], axis=1)

    if dtype == "Q8_0":
        return (half(0) * b[:, 2:].view(np.int8)).ravel()
    if dtype == "Q4_0":
        return (half(0) * (nibbles(b[:, 2:]).astype(np.float32) - 8)).ravel()
    if dtype == "Q4_1":
        return (half(0) * nibbles(b[:, 4:]) + half(2)).ravel()
    if dtype in ("Q5_0", "Q5_1"):
        at = 2 if dtype == "Q5_0" else 4
        fifth = np.unpackbits(b[:, at : at + 4], axis=1, bitorder="little")
        q = (nibbles(b[:, at + 4 :]) | (fifth << 4)).astype(np.float32)
        return (half(0) * (q - 16)).ravel() if dtype == "Q5_0" else (half(0) * q + half(2)).ravel()
    if dtype == "IQ4_NL":
        return (half(0) * np.array(LEVELS, np.float32)[nibbles(b[:, 2:])]).ravel()
    if dtype == "IQ4_XS":
        high = b[:, 2:4].copy().view("<u2").astype(np.int32)
        low = np.stack([b[:, 4:8] & 15, b[:, 4:8] >> 4], axis=2).reshape(-1, 8).astype(np.int32)
        scale = (low | (((high >> (2 * np.arange(8))) & 3) << 4)) - 32
        q = b[:, 8:].reshape(-1, 8, 16)
        return ((half(0) * scale)[:, :, None] * np.array(LEVELS, np.float32)[np.concatenate([q & 15, q >> 4], axis=2)]).ravel()
    shifts = 2 * np.arange(4, dtype=np.uint8)[:, None]
    if dtype == "Q2_K":
        s = b[:, :16]
        q = ((b[:, 16:80].reshape(-1, 2, 1, 32) >> shifts) & 3).reshape(-1, 16, 16).astype(np.float32)
        return ((half(80) * (s & 15))[:, :, None] * q - (half(82) * (s >> 4))[:, :, None]).ravel()
    if dtype == "Q3_K":
        s, top = b[:, 96:104], b[:, 104:108]
        scale = np.concatenate([s & 15, s >> 4], axis=1) | np.concatenate([((top >> n) & 3) << 4 for n in (0, 2, 4, 6)], axis=1)
        absent = 1 - ((b[:, :32].reshape(-1, 1, 1, 32) >> np.arange(8, dtype=np.uint8).reshape(2, 4, 1)) & 1).astype(np.float32)
        q = ((b[:, 32:96].reshape(-1, 2, 1, 32) >> shifts) & 3).astype(np.float32) - 4 * absent
        return ((half(108) * (scale.astype(np.float32) - 32))[:, :, None] * q.reshape(-1, 16, 16)).ravel()
    if dtype in ("Q4_K", "Q5_K"):
        s = b[:, 4:16]
        scale = np.concatenate([s[:, :4] & 63, (s[:, 8:] & 15) | ((s[:, :4] >> 6) << 4)], axis=1)
        least = np.concatenate([s[:, 4:8] & 63, (s[:, 8:] >> 4) | ((s[:, 4:8] >> 6) << 4)], axis=1)
        q = b[:, -128:].reshape(-1, 4, 32)
        q = np.stack([q & 15, q >> 4], axis=2).reshape(-1, 8, 32)
        if dtype == "Q5_K":
            q = q | (((b[:, 16:48].reshape(-1, 1, 32) >> np.arange(8, dtype=np.uint8)[:, None]) & 1) << 4)
        q = q.astype(np.float32)
        return ((half(0) * scale)[:, :, None] * q - (half(2) * least)[:, :, None]).ravel()
    if dtype == "Q6_K":
        low, high = b[:, :128].reshape(-1, 2, 2, 32), b[:, 128:192].reshape(-1, 2, 1, 32)
        scale = b[:, 192:208].view(np.int8).reshape(-1, 2, 4, 2, 1).astype(np.float32)
        four = np.concatenate([low & 15, low >> 4], axis=2)
        two = (high >> np.array([0, 2, 4, 6], np.uint8)[:, None]) & 3
        q = (four | (two << 4)).astype(np.float32) - 32
        return (half(208)[:, :, None, None, None] * scale * q.reshape(-1, 2, 4, 2, 16)).ravel()
    raise ValueError(f"no decoder for {dtype}")
