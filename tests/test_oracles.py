"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from haggleframe.plans import registry  # noqa: I001
import haggleframe.plans  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    sql = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    ours = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    at = [sql.columns.index(c) for c in sorted(sql.columns)]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in sql.fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
