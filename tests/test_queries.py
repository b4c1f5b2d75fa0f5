"""Every registered query against DuckDB on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, bool | str | bytes):
        return v
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    v = float(v)
    return "nan" if math.isnan(v) else float(f"{v:.9g}")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, D)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = duck.execute(entry.oracle_sql()[name])
    own = [x[0] for x in cur.description]
    assert sorted(own) == names
    want = sorted((tuple(norm(r[own.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n in set(entry.base.QUERIES) - set(entry.base.SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, D).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_base_stands_alone(tmp_path):
    """Without the optional subpackage the entry still imports and offers its own queries."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name == 'corpus_pipeline' or name.startswith('loomframe.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'annotate' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, check=True)
