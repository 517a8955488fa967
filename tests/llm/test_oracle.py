"""Tied groups against a recursive query of DuckDB over the whole of the smallest test data; shapes of all results."""

from pathlib import Path

import pytest

from judgelake.llm import queries

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")

SHAPES = {
    "p1_found": {"record_id": "bigint", "group_id": "bigint"},
    "p3_found": {"origin": "string", "record_id": "bigint", "pos": "bigint", "defect": "string"},
    "p4_found": {"record_id": "bigint", "cand_pos": "bigint", "field": "string", "value_pos": "bigint"},
    "p5_found": {"record_id_a": "bigint", "record_id_b": "bigint"},
    "p6_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p8_found": {"doc_id": "bigint", "subject": "string"},
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shapes(spark, name):
    df = queries.queries()[name](spark, str(DATA))
    assert dict(df.dtypes) == SHAPES[name]
    rows = df.collect()
    assert len({str(r) for r in rows}) == len(rows)


def test_groups(spark):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = {tuple(r) for r in queries.p1_found(spark, str(DATA)).collect()}
    assert got == set(c.execute(queries.oracle_sql()["p1_found"]).fetchall())
