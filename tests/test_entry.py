import decimal
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from vitalspark.plans.catalogue import QUERIES
from vitalspark.plans.oracles import SQL

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that rightly find nothing in the test data.
EMPTY = {"anti_never_ordered", "dictionary_search"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    return f"{v:.7g}" if isinstance(v, float) else f"{float(v):.7g}" if isinstance(v, decimal.Decimal) else str(v)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    made = QUERIES[name](spark, FOLDER)
    columns = sorted(made.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in made.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want and (got or name in EMPTY)


def test_anti_join_finds_customers_without_orders(spark, tmp_path):
    """On rows made for it: each customer of the test data has an order."""
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1,), (1,), (None,)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, QUERIES["anti_never_ordered"](spark, str(tmp_path)).collect())) == [(2, "b"), (3, None)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_part(tmp_path):
    """The rest works with the optional subpackage and the pipeline deleted."""
    import shutil

    root = Path(entry.__file__).parent
    for name in ("vitalspark", "__spark_entry__.py"):
        source = root / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "vitalspark" / "llm", ignore_errors=True)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'km_overall' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
