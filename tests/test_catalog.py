"""Every registered query against its SQL on the smallest tables, with a strict comparison."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

BASE = "/root/testdata/sf0.001"
NAMES = list(entry.queries())

pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from tools.check import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{BASE}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    from tools.check import canonical

    got = entry.queries()[name](spark, BASE).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    assert a.equals(b)


def test_tasks_of_the_trade_graph_hold_a_bounded_number_of_rows(tmp_path, spark, monkeypatch):
    from lorefield import session
    from lorefield.catalog import inputs as src

    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    tables = {
        "customer": ("c_custkey long, c_nationkey int", [(1, 1)]), "supplier": ("s_suppkey long, s_nationkey int", [(1, 1)]), "nation": ("n_nationkey int, n_regionkey int", [(1, 1)]),
        "orders": ("o_orderkey long, o_custkey long", [(i, i % 7) for i in range(100)] + [(5, 1), (None, 2)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(i % 101, i % 5, i % 3) for i in range(300)] + [(None, 1, 1)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = src.trade_edges(spark, str(tmp_path))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    for keys in ("o_custkey", "l_partkey"):
        assert any(f"hashpartitioning({keys}" in line and ", 31)" in line for line in plan.splitlines())
    got = {(r.src, r.dst): r.weight for r in edges.where("relation = 'bought'").collect()}
    want = {}
    for o, c in tables["orders"][1]:
        for l, p, _ in tables["lineitem"][1]:
            if o is not None and o == l:
                want[f"customer:{c}", f"part:{p}"] = want.get((f"customer:{c}", f"part:{p}"), 0) + 1
    assert got == want
