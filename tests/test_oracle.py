"""Every registered query runs at the smallest size; those with SQL agree with DuckDB."""

import math
import os

import duckdb
import pytest

from lexipress.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float) or type(a).__name__ == "Decimal" or type(b).__name__ == "Decimal":
        return a == b or (a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9))
    return a == b


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    out = registry.queries()[name](spark, SF)
    columns = sorted(out.columns)
    got = [tuple(r) for r in out.select(*columns).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got and len(set(columns)) == len(columns)  # compared in test_library.py or by invariants
        return
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    key = lambda r: [(x is not None, str(round(x, 6)) if isinstance(x, float) else str(x)) for x in r]
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))]
    assert not bad, bad[:3]
