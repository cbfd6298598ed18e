"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from flowscope.workload.registry import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else f"{float(value) + 0.0:.9g}"
    return str(value)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, db, name):
    df = queries()[name](spark, FOLDER)
    got = table([tuple(r) for r in df.collect()], df.columns)
    cursor = db.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert got == table(cursor.fetchall(), names)


@pytest.mark.parametrize("blocked", ["regex", "zstandard", "public_tokenizers", "corpus_pipeline", "flowscope.llm", "flowscope.llm.queries"])
def test_registry_without_a_module(blocked):
    """What can't be imported takes only the corpus queries away."""
    code = f"import sys; sys.modules['{blocked}'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    others = [len(QUERIES), sum(q.sql is not None for q in QUERIES.values())]
    assert all(a >= b for a, b in zip(map(int, out.split()), others, strict=True))
    if blocked.startswith("flowscope"):
        assert list(map(int, out.split())) == others


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 2 and all(0 < r.blacklisted <= r.flows for r in rows)


def test_extraction_modes(spark):
    from pyspark.sql import functions as F

    from flowscope import schema
    from flowscope.plans.extract import extract_features
    from flowscope.workload import fixtures as fx

    clients, servers = fx.view(spark, FOLDER, "client_hello"), fx.view(spark, FOLDER, "server_hello")
    known = fx.intelligence(spark, FOLDER)
    wide = extract_features(clients, servers, known, F.col("malware_label"), one_to_one=True, stop_at_error=True)
    assert wide.columns == ["flow_id", *schema.FEATURE_COLUMNS]
    rows = wide.select("flow_id", "cs_unknown", "sig_070A").collect()
    assert 0 < len(rows) == len({r.flow_id for r in rows}) <= clients.count()
    assert all(r.sig_070A == 0 for r in rows)
