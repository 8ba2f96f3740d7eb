import duckdb
import pytest

import __spark_entry__ as entry
from inkgrid.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return [columns[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(catalogue.ORACLES[name])
    want = rows([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1]) and got[1] == want[1]
    assert want[1], "a query without rows shows nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_greedy_matching_equals_a_sequential_pass(spark):
    from inkgrid.plans.geometry import pairs

    sf = "/root/testdata/sf0.001"
    taken, want = set(), set()
    for r in sorted(pairs(spark, sf).collect(), key=lambda r: (-r.shared, r.apart, r.u, r.v)):
        if not {r.u, r.v} & taken:
            taken |= {r.u, r.v}
            want.add((r.u, r.v))
    assert {(r.u, r.v) for r in catalogue.QUERIES["greedy_matching"](spark, sf).collect()} == want
