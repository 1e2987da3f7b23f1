import os

import pytest

import __spark_entry__ as E
from tests.oracle_check import check, duck


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.count() > 0
    assert out.columns == ["l_returnflag", "Sum_l_extendedprice"]


def test_every_oracle_key_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 150


@pytest.mark.skipif(os.environ.get("GRIDSPARK_SKIP_ORACLE") == "1", reason="oracle run disabled")
def test_oracle_matches_at_sf0001(spark):
    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    sqls = E.oracle_sql()
    bad = []
    for key, fn in E.queries().items():
        r = check(spark, con, key, fn, sqls.get(key), sf)
        if r["status"] not in ("ok", "rows-only"):
            bad.append(r)
    assert not bad, bad[:3]
