"""Every registered query with an oracle equals its DuckDB SQL at sf0.01."""
import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_harness import compare, duck

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF001).toPandas()
    want = con.execute(E.oracle_sql()[key]).df()
    ok, msg = compare(got, want)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["location", "rang", "pct_normal", "pct_suspect", "pct_fraude"]
