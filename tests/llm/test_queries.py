"""The registered queries over the smallest tables: columns, rows, and SQL where there is any."""

import glob
import os

import duckdb
import pytest

from graphlode.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["kind", "cluster_key", "member_key"], "p2_found": ["project", "file_path"], "p4_found": ["table_name", "item_key", "line_no"], "p5_found": ["project", "file_path"], "p6_found": ["id_a", "id_b"],
    "p7_found": ["project", "qualified_name"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark):
    df = registry.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and (name == "p7_pairs" or len(set(rows)) == len(rows))
    if name in registry.ORACLES:
        con = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        rel = con.sql(registry.ORACLES[name])
        assert list(rel.columns) == df.columns and sorted(tuple(map(str, r)) for r in rel.fetchall()) == sorted(rows)
