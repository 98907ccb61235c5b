"""Queries against their DuckDB SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

from kinspark.plans import catalogue

SF = "/root/testdata/sf0.001"
CHECKED = [
    "verdict", "score_candidates", "features", "background_range", "neutral_override", "auroc", "midrank", "calibration_gap", "export_pairs", "pair_except", "atlas_edges",
    "affine_fit_3", "merge_notes", "mix_yaml", "canonicalize", "coverage", "quant_pick", "claims", "consistency", "upsert", "new_candidates", "node_order",
    "sigma_curve", "vector_sample", "fnv1a_seed", "lcg_offsets", "seeded_sample", "coalesce_ranges", "range_lookup", "block_span",
    "roles_by_layer", "float32", "day_of", "latest_scan", "html_escape", "byte_totals", "merge_cards", "report_rows",
]


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else repr(float(v) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(catalogue.ORACLE_SQL[name])
    assert columns == sorted(expected.columns)
    rows = expected.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(tuple(map(plain, r)) for r in df.select(columns).collect()) == sorted(tuple(map(plain, r)) for r in rows)


def test_every_sql_has_its_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) > 100
