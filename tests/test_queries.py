"""Every registered query against its SQL, and the entry point without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from loomgraph.plans import oracle, queries

TABLES = ("part", "customer", "supplier", "orders", "lineitem", "events", "region")


@pytest.fixture(scope="module")
def con(data):
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return made


def plain(v):
    return int(v) if isinstance(v, float) and v.is_integer() else v


def test_all_have_sql():
    assert set(queries.QUERIES) == set(oracle.ORACLE)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, data, con, name):
    got = queries.QUERIES[name](spark, data)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in got.columns) + f" FROM ({oracle.ORACLE[name]})").fetchall()
    norm = lambda rows: sorted(repr(tuple(map(plain, r))) for r in rows)
    assert norm(got.collect()) == norm(want)


def test_rounding_of_any_double(spark, con):
    x = "VALUES (1.7976931348623157e308::DOUBLE), ('nan'::DOUBLE), (NULL), (0::DOUBLE), (-2.5e-10::DOUBLE), (0.1515457474::DOUBLE), (-12345.6789::DOUBLE), (9007199.254740993::DOUBLE), (9.3e9::DOUBLE), (-9.3e9::DOUBLE), (1e300::DOUBLE)"
    want = con.sql(f"SELECT val, {oracle.num('val', '1e9')} FROM ({x}) AS t(val)").fetchall()
    got = spark.createDataFrame([(v,) for v, _ in want], "val double").select("val", queries.c("val", "rounded", 1e9)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_unreachable_vertices_equal_sql(spark, tmp_path):
    tables = {  # the third customer has no orders, the last part is bought by one whom source 3 can't reach
        "part": ("p_partkey long", [(k,) for k in range(6)]),
        "customer": ("c_custkey long", [(k,) for k in range(3)]),
        "supplier": ("s_suppkey long", [(0,)]),
        "orders": ("o_orderkey long, o_custkey long", [(0, 0), (1, 1)]),
        "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double", [(0, 1, 3, 0, 4.0), (0, 2, 4, 0, 3.0), (1, 1, 5, 0, 2.0)]),
    }
    made = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("shortest_inverse_weight", "bfs_hops"):
        got = {tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == set(made.sql(f"SELECT node, dist FROM ({oracle.ORACLE[name]})").fetchall())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(tmp_path):
    top = Path(__file__).resolve().parent.parent
    for p in top.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "loomgraph"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "loomgraph").mkdir()
    for p in (top / "loomgraph").iterdir():
        if p.name != "llm":
            (tmp_path / "loomgraph" / p.name).symlink_to(p)
    entry = (top / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ndcg' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
