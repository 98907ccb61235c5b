"""Spark data source `tensors`: checkpoints as tables.

Options: path; mode `catalog` (a row for each tensor, headers alone are read) or
`blocks` (rows of at most block_len elements); filters on tensor and shard are
pushed into the reader, so that only the ranges asked for are read.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions.names import QUANT_TAGS
from . import files

CATALOG = "shard string, tensor string, dtype string, shape array<bigint>, numel bigint, byte_start bigint, byte_end bigint, block_elems int, block_bytes int, perm_heads int"
BLOCKS = "shard string, tensor string, dtype string, elem_start bigint, values array<double>"
#: Elements of a row, and bytes of a partition, about.
BLOCK_LEN, PARTITION_BYTES = 16384, 32 << 20


def shards(path: str) -> list[str]:
    """The weight files of a checkpoint: those an index lists, else the safetensors files of the folder itself (without
    adapters), else the best quantisation of a quantised model, with all its parts."""
    import json

    found = files.list_files(path)
    top = [f for f in found if f == path or "/" not in f[len(path.rstrip("/")) + 1 :]] or found
    index = [f for f in top if f.endswith(".safetensors.index.json")]
    if index:
        f = files.RangeFile(index[0])
        listed = set(json.loads(f.read(0, f.size))["weight_map"].values())
        return sorted(x for x in found if x[len(index[0].rsplit("/", 1)[0]) + 1 :] in listed)
    tensors = [f for f in top if f.endswith(".safetensors") and not f.rsplit("/", 1)[-1].startswith("adapter")]
    if tensors:
        return tensors
    models: dict[str, list[str]] = {}
    for f in found:
        name = f.rsplit("/", 1)[-1].lower()
        if name.endswith(".gguf") and not name.startswith("mmproj"):
            models.setdefault(re.sub(r"-\d{5}-of-\d{5}\.gguf$", ".gguf", f, flags=re.I), []).append(f)
    if not models:
        raise FileNotFoundError(f"{path}: no weights")

    def rank(name: str) -> int:
        return next((i for i, tag in enumerate(QUANT_TAGS) if tag in name.rsplit("/", 1)[-1].lower()), len(QUANT_TAGS))

    return sorted(models[min(models, key=lambda m: (rank(m), m))])


def stored_config(shard: str) -> dict:
    return files.gguf_config(shard)


def catalog(shard: str) -> list[dict]:
    return files.safetensors_catalog(shard) if shard.endswith(".safetensors") else files.gguf_header(shard)[1]


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "catalog")
        self.block_len = int(options.get("block_len", BLOCK_LEN))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("tensor", "shard"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def _keeps(self, row: dict) -> bool:
        return all(row[c] in v for c, v in self.wanted.items())

    def partitions(self):
        names = [s for s in shards(self.path) if "shard" not in self.wanted or s in self.wanted["shard"]]
        if self.mode == "catalog":
            return [InputPartition(s) for s in names]
        out, held, size = [], [], 0
        for row in (r for s in names for r in catalog(s) if self._keeps(r)):
            blocks = max(1, self.block_len // row["block_elems"])
            total = row["numel"] // row["block_elems"]
            for first in range(0, total, blocks):
                n = min(blocks, total - first)
                held.append({**row, "first": first, "n": n})
                size += n * row["block_bytes"]
                if size >= PARTITION_BYTES:
                    out, held, size = [*out, InputPartition(held)], [], 0
        return [*out, InputPartition(held)] if held or not out else out

    def read(self, partition):
        if self.mode == "catalog":
            for r in catalog(partition.value):
                if self._keeps(r):
                    yield tuple(r[c.split()[0]] for c in CATALOG.split(", "))
            return
        opened: dict = {}
        for p in partition.value:
            if p["shard"] not in opened:
                opened[p["shard"]] = files.RangeFile(p["shard"])
            f = opened[p["shard"]]
            raw = f.read(p["byte_start"] + p["first"] * p["block_bytes"], p["n"] * p["block_bytes"])
            values = files.decode(raw, p["dtype"]).astype(float).tolist()
            yield p["shard"], p["tensor"], p["dtype"], p["first"] * p["block_elems"], values


class TensorSource(DataSource):
    @classmethod
    def name(cls):
        return "tensors"

    def schema(self):
        return BLOCKS if self.options.get("mode", "catalog") == "blocks" else CATALOG

    def reader(self, schema):
        return TensorReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TensorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
