import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lodestone import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(x):
    """Pandas holds whole numbers with nulls as floats."""
    if x is None or x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)) or isinstance(x, (float, np.floating)) and float(x).is_integer():
        return int(x)
    return f"{x:.6g}" if isinstance(x, (float, np.floating)) else str(x)


def table(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return list(df.columns), sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, oracle, name):
    assert table(plans.QUERIES[name](spark, DATA).toPandas()) == table(oracle.execute(plans.SQL[name]).df())


def test_rows_only_queries(spark):
    for name in plans.QUERIES.keys() - plans.SQL.keys():
        assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 300
    assert plans.QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


def test_works_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "lodestone"), tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(plans.QUERIES)), "False"], said.stderr
