"""Each catalogued query against its SQL in DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry_without_training_operators():
    """The entry module works when the subpackage and the pipeline are gone."""
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as d:
        for n in ("__spark_entry__.py", "tessera"):
            os.symlink(f"{root}/{n}", f"{d}/{n}") if n.endswith(".py") else None
        os.mkdir(f"{d}/tessera")
        for n in os.listdir(f"{root}/tessera"):
            if n not in ("llm", "__pycache__"):
                os.symlink(f"{root}/tessera/{n}", f"{d}/tessera/{n}")
        code = "import __spark_entry__ as e; q = e.queries(); assert 'outcomes' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
        # the link would resolve to the real folder, so the file is read and run from here
        src = open(f"{root}/__spark_entry__.py").read()
        os.remove(f"{d}/__spark_entry__.py")
        open(f"{d}/__spark_entry__.py", "w").write(src)
        subprocess.run([sys.executable, "-c", code], cwd=d, check=True, env={**os.environ, "PYTHONPATH": d, "PYTHONDONTWRITEBYTECODE": "1"})


def test_types_match(spark, sf, duck):
    """Dates stay dates on both sides."""
    row = catalogue.QUERIES["step_last_wins"](spark, sf).first()
    assert isinstance(row.step, datetime.date)
