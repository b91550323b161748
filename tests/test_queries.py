"""Every relational query against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidemill.plans.registry import ORACLE, QUERIES
import tidemill.plans  # noqa: F401
from tidemill.plans import load_all

load_all()
DATA = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        con = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        con.execute("set timezone='UTC'")
        rel = con.execute(ORACLE[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, rel.fetchall())
