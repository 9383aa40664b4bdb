"""Every registered query against its SQL on the smallest tables, and the contract of the entry points."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"p50_ms", "p95_ms", "mad_ms", "status"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]).startswith("ok")
    else:
        assert df.count() > 0
