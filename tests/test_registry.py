"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest
from codeloom import registry

TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def rows_of(relation, columns):
    return sorted(str(tuple(r)) for r in relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    if name in registry.ORACLE_SQL:
        want = db.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == columns and got == rows_of(want, columns)
    else:
        assert got


def test_entry_without_text_operators(tmp_path):
    """In a copy without the text operators all else imports, and their queries are gone; with them the pipeline imports nothing by itself."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.log"))
    shutil.rmtree(copy / "codeloom/llm")
    shutil.rmtree(copy / "tests/llm", ignore_errors=True)
    said = "import corpus_pipeline; print(len(corpus_pipeline.STAGES)); import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.QUERIES), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", said], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out[-3:] == ["5", "True", "False"]
    os.remove(copy / "corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", said.replace("import corpus_pipeline; print(len(corpus_pipeline.STAGES)); ", "")], cwd=copy, env=env, check=True)
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
