import os
from collections import Counter

import duckdb
import pytest

from citeloom.llm.oracles import ORACLES
from citeloom.llm.queries import QUERIES

COLUMNS = {
    "p1_found": [("record_id_a", "bigint"), ("record_id_b", "bigint")],
    "p3_found": [("record_id", "bigint"), ("pos", "int"), ("term_id", "bigint")],
    "p4_found": [("field_name", "string"), ("item_a", "string"), ("item_b", "string")],
    "p6_found": [("keyword", "string"), ("mark", "string")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p10_found": [("doc_id_a", "bigint"), ("doc_id_b", "bigint")],
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        con = duckdb.connect()
        for f in os.listdir(sf):
            con.sql(f"create view {f.split('.')[0]} as from '{sf}/{f}'")
        want = con.sql(ORACLES[name])

        def bag(columns, rows):
            order = sorted(range(len(columns)), key=lambda i: columns[i])
            return sorted(columns), Counter(tuple(repr(r[i]) for i in order) for r in rows)

        assert bag(df.columns, rows) == bag(want.columns, want.fetchall())
