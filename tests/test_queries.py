"""Every query of the core against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weftline.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    one = lambda v: None if v is None else round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    cell = lambda v: None if isinstance(v, float) and math.isnan(v) else one(v)
    return sorted(names), sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = sql.execute(ORACLE_SQL[name])
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want
