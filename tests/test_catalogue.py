"""Every query with an oracle gives DuckDB's rows; the others run."""

from __future__ import annotations

import duckdb
import pytest

from strideframe.plans import catalogue, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    cur = con.execute(oracles.SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    df = catalogue.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want
    assert want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(oracles.SQL)))
def test_other_queries_run(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_the_entry_survives_without_the_corpus_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/strideframe", tmp_path / "strideframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(catalogue.QUERIES)
