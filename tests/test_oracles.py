"""Every query against its SQL at sf0.01."""

import math
import os

import duckdb
import pytest

from rillmap import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SCALES = [s for s in ("sf0.01",) if os.path.isdir(f"/root/testdata/{s}")]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("scale", SCALES)
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name, scale):
    folder = f"/root/testdata/{scale}"
    got = catalog.queries()[name](spark, folder)
    rows = got.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    a = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=key)
    b = sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert a == b
