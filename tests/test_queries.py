"""Every query with an SQL twin gives the same rows as DuckDB over the same files."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__
from sealstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table: pa.Table) -> list:
    table = table.select(sorted(table.column_names))
    plain = lambda v: round(v, 9) if isinstance(v, float) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v
    return sorted((tuple(plain(v) for v in r.values()) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, spark, duck):
    got, want = catalog.QUERIES[name](spark, SF).toArrow(), duck.execute(catalog.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    out = __spark_entry__.entry(spark).collect()
    assert len(out) == 20 and len({r.manifest_root for r in out}) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_and_repeats(name, spark):
    one, two = (catalog.QUERIES[name](spark, SF).toArrow() for _ in range(2))
    assert rows(one) == rows(two) and len(rows(one)) > 0


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_conjunction"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan and "ReadSchema: struct<l_orderkey" in plan and "l_shipdate" not in plan.split("ReadSchema")[1]


def test_no_join_by_all_pairs(spark):
    for name in ("equivocation", "first_covering_checkpoint", "trust_half_open", "version_diff"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
