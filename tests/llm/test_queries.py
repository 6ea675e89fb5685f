"""The pN_ queries on the smallest tables: columns as TESTDATA.md gives them, SQL where there is one."""

import os

import duckdb
import pytest

from quire.llm import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
COLUMNS = {
    "p1_found": ["ethnos_a", "ethnos_b"], "p2_found": ["term", "mark"], "p3_found": ["doc_id", "line_no", "kind"], "p4_found": ["doc_id"], "p5_found": ["doc_id_a", "doc_id_b"],
    "p6_found": ["doc_id", "start_char", "end_char"], "p7_found": ["doc_id", "sentence_index"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))
    if name in oracle.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        cur = con.execute(oracle.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        assert sorted(map(str, ([r[c] for c in cols] for r in rows))) == sorted(str(list(r)) for r in cur.fetchall())
