import importlib
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.plans import oracle, registry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    base.sql("SET timezone = 'UTC'")
    for name in TABLES:
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return base


@needs_data
@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(oracle.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_library_stands_without_the_optional_part(tmp_path):
    for name in os.listdir(ROOT):
        if name != ".git":
            os.symlink(os.path.join(ROOT, name), tmp_path / name) if name != "tidewell" else None
    os.mkdir(tmp_path / "tidewell")
    for name in os.listdir(os.path.join(ROOT, "tidewell")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "tidewell", name), tmp_path / "tidewell" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert 'pipeline' not in q; from tidewell.session import local_session; s = local_session(1, 1, '1g'); assert q['binarize'](s, '" + DATA + "').count() > 0"
    os.remove(tmp_path / "__spark_entry__.py")
    with open(os.path.join(ROOT, "__spark_entry__.py")) as f:
        (tmp_path / "__spark_entry__.py").write_text(f.read())
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert importlib.import_module("tidewell")
