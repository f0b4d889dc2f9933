"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from shotloom.plans.registry import SCHEMA_ORACLE, SCHEMA_STEPS
from tools.oracle_check import digest

from conftest import SF_SMALL

KEYS = sorted(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["target_id", "demo_id", "score", "rank"]
    assert len(rows) > 0


def test_every_query_has_oracle_or_is_listed():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS + sorted(SCHEMA_STEPS))
def test_query_matches_oracle(spark, duck, key):
    df = (E.queries() | SCHEMA_STEPS)[key](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    sql = (E.oracle_sql() | SCHEMA_ORACLE).get(key)
    if sql is None:
        assert rows and len(set(cols)) == len(cols)
        return
    res = duck.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]
