import math

import duckdb
import pytest

from darkslide.plans import catalog

SF = "/root/testdata/sf0.001"


def _rows(rows):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(map(plain, r))) for r in rows)


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    assert _rows(df.select(*names).collect()) == _rows([[r[i] for i in at] for r in want.fetchall()])
