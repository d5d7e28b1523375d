"""Every query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from citeloom.plans import registry

ORACLES = registry.oracles()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as from '{sf}/{f}'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(c for c in columns), Counter(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, sf, db, name):
    df = registry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        want = db.sql(ORACLES[name])
        assert bag(df.columns, rows) == bag(want.columns, want.fetchall())
    else:
        assert rows


def test_the_library_does_not_need_the_optional_part():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"citeloom\.llm|from \.+llm", path.read_text()), path
