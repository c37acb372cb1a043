"""Every registered query against its SQL."""

import pytest

from tessera.plans.catalog import ORACLES, QUERIES
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, oracle.DATA)
    if name in ORACLES:
        oracle.check(df, ORACLES[name], con)
    else:
        assert df.columns and df.count() >= 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_fifo_in_a_stream_equals_the_batch(spark):
    both = [sorted(map(tuple, QUERIES[n](spark, oracle.DATA).collect())) for n in ("fifo_cache", "stream_fifo")]
    assert both[0] == both[1]


def test_parts_numbered_like_suppliers_stay_parts(spark, tmp_path):
    tables = {
        "part": ("p_partkey", [1_000_002, 1_000_003, 1_000_004, None]),
        "supplier": ("s_suppkey", [2, 3, None]),
        "lineitem": ("l_partkey long, l_suppkey", [(1_000_002, 3, 5.0), (1_000_003, 2, 7.0), (1_000_003, 2, 6.0), (1_000_003, 3, 4.0), (1_000_002, 1_000_004, 1.0), (3, 2, 1.0), (1_000_004, None, 1.0)]),
    }
    con = oracle.duckdb.connect()
    for name, (keys, data) in tables.items():
        more = ", l_quantity double" if name == "lineitem" else ""
        spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in data], f"{keys} long{more}").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["edges_both_ways"](spark, str(tmp_path))
    assert got.count() == 6
    oracle.check(got, ORACLES["edges_both_ways"], con)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
