"""The driver's contract: imports without a session, the flagship query, every query with its SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from assaygrid.plans.registry_network import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); import assaygrid.functions.dist"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_works_without_the_optional_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'welch_full' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(r.p is None or 0 <= r.p <= r.q <= 1 for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cells(frame, columns):
    shown = lambda x: "" if pd.isna(x) else repr(round(float(x), 5) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(map(shown, row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    kinds, ours = dict(ours.dtypes), ours.toPandas()
    theirs = duck.sql(SQL[name])
    theirs_kinds, theirs = dict(zip(theirs.columns, map(str, theirs.types))), theirs.df()
    assert {k: KINDS[v] for k, v in kinds.items()} == theirs_kinds
    columns = sorted(kinds)
    assert cells(ours, columns) == cells(theirs, columns)
