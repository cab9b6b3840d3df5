"""Every query of the library against its SQL over the smallest tables."""

import duckdb
import pytest

from quern import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for _, v in sorted(r.items())]) for r in found)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = registry.QUERIES[name](spark, sf)
    want = con.sql(registry.ORACLES[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    assert rows(got.toArrow().to_pylist()) == rows(want.to_pylist())
