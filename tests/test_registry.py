"""Every registered query of the reference's operators against its SQL."""

import math

import duckdb
import pytest

from kindred.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, con, name):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in registry.ORACLE_SQL:
        cur = con.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
