"""Every catalogued query against DuckDB on the driver's smallest tables."""

import duckdb
import pytest

from quarry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(str(plain(r[k])) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows_equal(spark, duck, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    rows = frame.collect()
    if name not in catalog.SQL:
        assert rows
        return
    rel = duck.sql(catalog.SQL[name])
    assert sorted(frame.columns) == sorted(rel.columns)
    assert table(frame.columns, rows) == table(rel.columns, rel.fetchall())
